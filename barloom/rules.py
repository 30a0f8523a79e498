"""Exchange rules, code conventions and published defaults."""

from __future__ import annotations

import datetime as dt

# ---- fixed values (market rules) --------------------------------------------
BOARDS = ("main", "gem", "star", "bse")
PRICE_LIMIT = {"main": 0.10, "gem": 0.20, "star": 0.20, "bse": 0.30}
ST_PRICE_LIMIT = {"main": 0.05, "gem": 0.20, "star": 0.20, "bse": 0.30}
# board -> (smallest order, step)
LOT_RULE = {"main": (100, 100), "gem": (100, 100), "star": (200, 1), "bse": (100, 1)}
NO_LIMIT_DAYS = {"main": 1, "gem": 5, "star": 5, "bse": 1}
LOT_SIZE = 100
TRADING_DAYS_YEAR = 242.0
MV_UNIT = 10_000.0  # total_mv is stored in units of 1e4 yuan

# ---- fixed values (dates) ----------------------------------------------------
OPEN_END = dt.date(2099, 12, 31)
DEFAULT_LIST_DATE = dt.date(1990, 1, 1)
FAR_FUTURE = dt.date(2100, 1, 1)

# ---- fixed values (code conventions) -----------------------------------------
# first digits of a code -> market; everything else is SZ
BJ_FIRST_DIGITS = ("4", "8")
SH_FIRST_DIGITS = ("5", "6", "9")
MARKET_SUFFIX = {"SH": "XSHG", "SZ": "XSHE", "BJ": "XBSE"}
SUFFIX_MARKET = {
    "XSHG": "SH", "SH": "SH",
    "XSHE": "SZ", "SZ": "SZ",
    "XBSE": "BJ", "XBEI": "BJ", "BJ": "BJ",
}
SHARE_PREFIXES = {"SH": ("60", "68"), "SZ": ("00", "30"), "BJ": ("4", "8")}

# ---- fixed values (statements) -----------------------------------------------
# landed dataset -> (stmt_type, landed column -> item name)
STATEMENT_ITEMS = {
    "income": ("income", {
        "revenue": "revenue",
        "n_income_attr_p": "net_profit",
        "basic_eps": "eps_basic",
        "operate_profit": "op_profit",
    }),
    "balancesheet": ("balance", {
        "total_assets": "total_assets",
        "total_liab": "total_liab",
        "total_hldr_eqy_exc_min_int": "equity",
    }),
    "cashflow": ("cashflow", {
        "n_cashflow_act": "cfo",
        "n_cashflow_inv_act": "cfi",
        "n_cash_flows_fnc_act": "cff",
    }),
}
STATEMENT_KINDS = ("income", "balance", "cashflow")
EMPTY_IS_LEGAL = ("suspend", "income", "balancesheet", "cashflow")
REUSE_IF_PRESENT = ("suspend",)

# ---- fixed values (research defaults) ------------------------------------------
# factor -> (look-back rows, kind)
SEED_FACTORS = {
    "mom_20": (20, "momentum"),
    "mom_60": (60, "momentum"),
    "vol_20": (20, "volatility"),
    "turn_20": (20, "turnover"),
    "ep": (0, "value"),
    "bp": (0, "value"),
}
VALUE_ITEMS = {"ep": "net_profit", "bp": "equity"}
FACTOR_VERSION = "v1"
# score dimension -> (factor, inverted)
DIMENSIONS = {
    "momentum": ("mom_20", False),
    "volatility": ("vol_20", True),
    "valuation": ("ep", False),
    "turnover": ("turn_20", True),
    "quality": ("bp", False),
}
UNIVERSE_FILTERS = ("st", "suspended", "listed_days<120", "limit_up_open")
WEIGHT_METHODS = ("equal", "factor_rank", "industry_neutral")
MIN_UNIVERSE = 500

# ---- fixed values (trading costs and tolerances) --------------------------------
COMMISSION_RATE = 0.0003
COMMISSION_MIN = 5.0
STAMP_TAX = 0.0005
SLIPPAGE_BPS = 5.0
LIMIT_EPS = 1e-4

# ---- fixed values (labels on a security card) -------------------------------------
STANCE = {"strong": "偏强", "neutral": "中性", "weak": "偏弱", "unknown": "unknown"}
TAGS = {
    "suspended": "停牌",
    "st": "ST",
    "limit_up": "涨停",
    "limit_down": "跌停",
    "momentum_strong": "动量偏强",
    "momentum_weak": "动量偏弱",
    "volatile": "波动偏高",
    "expensive": "估值偏贵",
    "cheap": "估值偏便宜",
    "crowded": "换手拥挤",
    "beats_benchmark": "跑赢基准",
    "trails_benchmark": "跑输基准",
    "factors_missing": "因子不全",
    "finance_stale": "财务数据陈旧",
    "industry_momentum_top": "行业动量顶尖",
    "industry_momentum_bottom": "行业动量垫底",
    "industry_value_top": "行业价值顶尖",
    "not_tradable": "不可交易",
    "trade_with_care": "交易谨慎",
}

# fixed values (columns of the indicator payload, in order)
PAYLOAD = (
    "trade_date", "open", "high", "low", "close", "volume", "ma5", "ma10",
    "boll_mid", "boll_upper", "boll_lower", "dif", "dea", "macd_hist", "k", "d", "j",
)

# fixed values (thresholds of stance and tags)
STANCE_STRONG, STANCE_WEAK = 58, 42
SCORE_HIGH, SCORE_LOW = 70, 30
STRENGTH_GAP = 0.03
PEER_TOP, PEER_BOTTOM = 0.9, 0.1
