"""Exceptions of the engine."""


class PeakflowError(Exception):
    """Base of all errors raised here."""


class DataReadingError(PeakflowError):
    """A source can't be read or lacks what a reader needs."""


class UnsupportedDataError(PeakflowError):
    """The data is readable but of a kind that has no meaning here, such as a run without MS2 windows."""


class DataProcessingError(PeakflowError):
    """An operator got inputs outside its contract."""


class EmptyDataError(DataProcessingError):
    """An operator that needs rows got none."""
