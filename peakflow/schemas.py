"""Explicit schemas in DDL: nothing is inferred, unknown JSON keys are ignored."""

FRAMES = (
    "frame_index bigint, rt double, ms_level int, acquisition_type string, window_group int, quad_major int, "
    "intensity_correction_factor double, scan_offsets array<bigint>, tof_indices array<bigint>, intensities array<bigint>"
)
QUAD_WINDOWS = (
    "quad_major int, quad_sub int, scan_start bigint, scan_end bigint, isolation_mz double, isolation_width double, isolation_low double, isolation_high double, collision_energy double"
)
RUN_META = (
    "run_id string, tof_intercept double, tof_slope double, scan_intercept double, scan_slope double, frame_intercept double, frame_slope double, lower_im double, upper_im double, lower_rt double, upper_rt double"
)
PEAKS = ("ms_level int, quad_major int, quad_sub int, frame_index bigint, rt double, scan_index bigint, tof_index bigint, intensity bigint")
ELUTION_GROUPS = (
    "id bigint, mobility float, rt_seconds float, precursor_mzs array<double>, fragment_mzs map<string,double>, "
    "expected_fragment_intensity map<string,float>, expected_precursor_intensity array<float>"
)
#: Comes first in each of the three where files hold several runs.
RUN_COLUMN = "run_id string"
PEAK_COLUMNS = tuple(f.split()[0] for f in PEAKS.split(", "))
