"""Names, limits and thresholds, in one place."""

from __future__ import annotations

# Fixed values of the radio standard.
SYMBOL_RATE = 1e6
NOMINAL_DEVIATION = 250e3
ADVERTISING_ACCESS_ADDRESS = 0x8E89BED6
ADVERTISING_CRC_INIT = 0x555555
CRC_POLYNOMIAL_REFLECTED = 0xDA6000
CARRIER_HZ = 2.44e9

#: Measurements of a packet, in order; spectral ones need full extraction, antenna ones two receivers.
MEASUREMENTS = (
    "cfo_hz", "cfo_ppm", "cfo_preamble_hz", "cfo_payload_hz", "drift_hz", "drift_rate", "dev_one_hz", "dev_zero_hz", "dev_asymmetry",
    "modulation_index", "freq_error_rms", "freq_error_peak", "eye_opening", "residual_isi", "effective_bt", "transition_asymmetry",
    "symbol_clock_ppm", "symbol_jitter_ps", "phase_noise_10kHz", "phase_noise_50kHz", "phase_noise_100kHz", "phase_noise_500kHz",
    "lo_leakage_dbc", "image_rejection_db", "rise_time_us", "overshoot", "fall_time_us", "splatter_db", "rssi_dbfs", "rssi_dbm", "snr_db",
    "delay_spread_us", "antenna_phase_deg", "aoa_deg",
)
#: The feature vector, in order.
VECTOR = (
    "cfo_ppm", "modulation_index", "transition_asymmetry", "freq_error_rms", "drift_hz", "drift_rate", "symbol_clock_ppm", "rise_time_us",
    "overshoot", "effective_bt", "eye_opening", "residual_isi", "delay_spread_us", "splatter_db",
)
#: Entries of the vector that mean little without a calibrated clock.
CLOCK_BOUND = ("cfo_ppm", "drift_hz", "drift_rate", "symbol_clock_ppm")
#: Limits of the standard: (least, most).
LIMITS = {"cfo_hz": (-150e3, 150e3), "drift_hz": (-50e3, 50e3), "drift_rate": (-20e3, 20e3), "modulation_index": (0.45, 0.55), "deviation": (225e3, 275e3)}

# Fixed values, from here on: thresholds that results depend on.
# Demodulation.
GATE_DB, GATE_US, FLOOR_QUANTILE, FLOOR_ALPHA = 8.0, 4.0, 0.15, 0.05
SYNC_THRESHOLD, SYNC_AGREEMENT, SYNC_GAP_SYMBOLS = 0.62, 0.85, 8
CHANNEL_FILTER_HZ, MEASUREMENT_FILTER_HZ, FILTER_TAPS = 1.1e6, 2.5e6, 65
PRE_US, POST_US, MOST_PAYLOAD = 50.0, 20.0, 37
BT_SLOPE, BT_INTERCEPT = 0.4192, -0.0655

# Analysis.
CLUSTERS, CLUSTER_SPLIT, CLUSTER_RATE = 4, 1.30, 0.02
SEPARATION_PACKETS, SEPARATION_ALERT, SEPARATION_AFTER = 8, 0.9, 40
BIMODAL_SIGMA, BIMODAL_AFTER, BIMODAL_EVERY, BIMODAL_HISTORY, BIMODAL_LEAST = 6.0, 60, 16, 384, 40
SPLIT_FRACTION, SPLIT_LEAST = 0.15, 20
BURST_US, BURST_COUNT, BURST_ROWS = 20_000.0, 3, 8
ANOMALY_ALERT, BASELINE_LEAST, BASELINE_FEATURE_LEAST = 3.0, 10, 5
ENROLL_PACKETS, ENROLL_TEMPERATURES, ENROLL_DISTANCES, DISTANCE_DB = 200, 3, 2, 6.0
MULTIPATH_ROWS, MULTIPATH_LEAST, MULTIPATH_MADS, MULTIPATH_KEEP = 64, 32, 6.0, 0.95
INTERVAL_CAP_US, HISTORY = 11_000_000.0, 256

# Charts and tables.
SERIES_ROWS, TRACKED, DRAWN, SERIES_GAP_S, TABLE_ROWS, SCATTER_ROWS, NOISE_ROWS = 600, 96, 8, 5.0, 20_000, 4000, 1800
PEAK_DECAY_DB = 0.35

# Calibration: clipping, peaks (dBFS) and how far below them the gain is low, DC (dBFS), gain ratio (percent), coherence.
CLIP, PEAK_TARGET, PEAK_SLACK, CALIBRATION_HISTORY = 0.98, (-15.0, -10.0), 15.0, 200
DC_MOST, GAIN_MOST_PERCENT, COHERENCE_FAULT, COHERENCE_GOOD = -40.0, 5.0, 0.3, 0.7
