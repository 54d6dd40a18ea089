"""Fixed values of the domain: thresholds, label lists and horizons."""

# --- fixed values -----------------------------------------------------------
HORIZONS = (1, 3, 5, 7, 10, 20, 60, 90, 180, 365)
REPORT_HORIZONS = (3, 7, 10, 20, 60, 90, 180, 365)
LONG_HORIZONS = (60, 90, 180, 365)

# (lower edge, label, code), left-closed, in ascending order of price
PRICE_BANDS = (
    (0.0, "<10", "B0"),
    (10.0, "10-49", "B7"),
    (50.0, "50-99", "B6"),
    (100.0, "100-249", "B5"),
    (250.0, "250-499", "B4"),
    (500.0, "500-999", "B3"),
    (1000.0, "1000-2499", "B2"),
    (2500.0, ">2500", "B1"),
)
# the older six-band scheme, kept as a separate named operator
LEGACY_PRICE_BANDS = (
    (0.0, "<10"),
    (10.0, "10-49"),
    (50.0, "50-99"),
    (100.0, "100-499"),
    (500.0, "500-999"),
    (1000.0, ">1000"),
)

TOP_N = 10
MAX_PER_BUCKET = 6
MAX_UNIVERSE = 3000
PRESCREEN_N = 150
MIN_TRADED_VALUE = 20_000_000.0
MIN_PRICE = 1.0
MAX_UNCERTAINTY = 10.0
MIN_NET_RETURN = 0.50
COST_PCT = 0.30            # 20 bps cost + 10 bps slippage, one way
BENCHMARK_TOLERANCE = 0.10
DIRECTION_THRESHOLD = 0.002
HIT_LEVELS = (1.0, 2.0, 3.0, 5.0)
HIT_MIN_SAMPLES = 60
JUMP_THRESHOLD = 0.05
JUMP_SESSIONS = 7
JUMP_TOP_N = 5
JUMP_POOL = 30
JUMP_MIN_SCORE = 65.0
JUMP_MIN_UPSIDE = 3.0
INTRADAY_TOP_N = 5
INTRADAY_MIN_ROWS = 20
INTRADAY_MIN_MOVE = 0.012
DRIFT_THRESHOLD = 0.20
EVIDENCE_SAMPLES = 50
WALK_MIN_TRAIN, WALK_FOLDS, WALK_EMBARGO = 45, 3, 1
PROMOTION_MIN_SAMPLES = 30
PROMOTION_DRAWS = 500
PROMOTION_P = 0.10
PROMOTION_MIN_GAIN = 0.02
ROLLBACK_MAPE = 5.0
ROLLBACK_DEGRADATION = 0.25
TARGET_PROFIT_PCT = 10.0
MIN_PLAN_CONFIDENCE = 60.0
REDUCE_GAP_PCT = 3.0
VOLATILITY_LOW, VOLATILITY_HIGH = 1.0, 3.0

# score per regime and direction (UP, NEUTRAL, DOWN)
REGIME_DIRECTION = {
    "BULL": (90.0, 55.0, 35.0),
    "BEAR": (35.0, 55.0, 80.0),
    "SIDEWAYS": (70.0, 55.0, 45.0),
}
REGIME_BASE_RISK = {"BULL": 85.0, "SIDEWAYS": 65.0, "BEAR": 40.0, "HIGH VOL": 30.0}
REGIME_MULTIPLIER = {"BULL": 1.05, "SIDEWAYS": 1.0, "BEAR": 0.88, "HIGH VOL": 0.78}
REGIME_SECTOR_SHIFT = {"BULL": 3.0, "BEAR": -3.0, "HIGH VOL": -5.0}

FEATURES = (
    "open", "high", "low", "close", "volume",
    "sma10", "sma20", "sma50", "ema9", "ema20", "rsi14",
    "macd", "macd_signal", "macd_hist",
    "bb_mid", "bb_upper", "bb_lower", "bb_position",
    "atr14", "atr_pct", "adx14",
    "return1", "return3", "return5", "return10", "return20",
    "volatility10", "volatility20", "volume_ratio", "obv", "obv_change",
    "close_vs_sma20", "close_vs_sma50", "ema9_vs_ema20", "high_low_range",
    "close_lag1", "close_lag2", "close_lag3", "close_lag5",
    "return_lag1", "return_lag2", "return_lag3", "return_lag5",
    "body_pct", "upper_wick", "lower_wick",
)
# ----------------------------------------------------------------------------
