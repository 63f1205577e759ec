"""The 65 named features of a bar panel, as expressions over any engine of `algebra`.

A feature is raw or normalised: NORM puts a raw value through the rolling robust norm (median
and median absolute deviation of the last 200 bars, 0 before), CLEAN leaves it as it is.
WILLR_14 is a constant 0 on any valid bar, because a share of the range that is never negative is
clamped to at most 0; that is kept as specified.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from .algebra import EPS, X

FEATURES: dict[str, "Feature"] = {}


@dataclass(frozen=True)
class Feature:
    name: str
    category: str
    norm: bool
    raw: Callable
    final: Callable | None = None

    def build(self, b, normal: bool = True) -> X:
        if normal and self.final:
            return self.final(b)
        x = self.raw(b)
        return b.rn(x) if normal and self.norm else x


def feature(name: str, category: str, norm: bool = False, final: Callable | None = None):
    def add(f: Callable) -> Callable:
        FEATURES[name] = Feature(name, category, norm, f, final)
        return f

    return add


def ret(b, n: int = 1) -> X:
    """Log return over n bars, 0 for the first n."""
    c = b.close
    return b.let(_windowed(b, b.where(b.i < n, 0.0, b.ln(c / (b.lag(c, n) + EPS)))))


def _windowed(b, x: X) -> X:
    return replace(x, win=True)


def named(b, x: X) -> X:
    """x as a column of its own, even where it holds no window function."""
    return b.let(_windowed(b, x))


def true_range(b) -> X:
    pc = b.prev(b.close)
    return named(b, b.hi2(b.hi2(b.high - b.low, b.abs(b.high - pc)), b.abs(b.low - pc)))


def atr(b, w: int = 14) -> X:
    return named(b, b.rmean(true_range(b), w))


def typical(b) -> X:
    return named(b, (b.high + b.low + b.close) / 3.0)


def deviation(b, x: X, mean: X) -> X:
    return (x - mean) / (mean + EPS)


def unit(b, x: X) -> X:
    return b.clamp(x, 0.0, 1.0)


def balanced(b, x: X) -> X:
    return b.clamp(x, -1.0, 1.0)


def place_in_range(b, w: int, x: X | None = None) -> X:
    top, bottom = named(b, b.rmax(b.high, w)), named(b, b.rmin(b.low, w))
    return ((b.close if x is None else x) - bottom) / (top - bottom + EPS)


def middle(b, w: int) -> X:
    return named(b, (b.rmax(b.high, w) + b.rmin(b.low, w)) / 2.0)


def money_flow(b) -> X:
    h, lo, c = b.high, b.low, b.close
    return named(b, ((c - lo) - (h - c)) / (h - lo + EPS) * b.volume)


def log_ratio(b, x: X, y: X) -> X:
    return b.ln((x + EPS) / (y + EPS))


@feature("RET", "trend", True)
def _ret(b):
    return ret(b)


@feature("RET5", "trend", True)
def _ret5(b):
    return ret(b, 5)


@feature("RET20", "trend", True)
def _ret20(b):
    return ret(b, 20)


@feature("MA_DIFF", "trend", True)
def _ma_diff(b):
    return b.rmean(b.close, 10) / (b.rmean(b.close, 30) + EPS) - 1.0


@feature("SLOPE20", "trend", True)
def _slope20(b):
    return b.slope(b.close, 20)


@feature("ATR", "volatility", True)
def _atr(b):
    return b.log1p(b.hi2(atr(b), 0.0))


@feature("RVOL", "volatility", True)
def _rvol(b):
    return b.log1p(b.rstd(ret(b), 20) + EPS)


@feature("HL_RANGE", "volatility", True)
def _hl_range(b):
    return (b.high - b.low) / (b.close + EPS)


@feature("VOL_REGIME", "volatility", True)
def _vol_regime(b):
    return atr(b) / (b.rmean(atr(b), 20) + EPS) - 1.0


@feature("DEV", "reversal", True)
def _dev(b):
    return deviation(b, b.close, named(b, b.rmean(b.close, 20)))


@feature("DEV60", "reversal", True)
def _dev60(b):
    return deviation(b, b.close, named(b, b.rmean(b.close, 60)))


@feature("RSI14", "reversal")
def _rsi14(b):
    step = named(b, b.close - b.prev(b.close))
    gain, loss = b.rmean(b.hi2(step, 0.0), 14), b.rmean(b.hi2(-step, 0.0), 14)
    rs = (gain + 1e-9) / (loss + 1e-9)
    return balanced(b, (100.0 - 100.0 / (1.0 + rs) - 50.0) / 50.0)


@feature("PRESSURE", "reversal")
def _pressure(b):
    span = b.high - b.low
    still = b.abs(span) < EPS
    return b.where(still, 0.0, balanced(b, (b.close - b.open) / b.where(still, 1.0, span)))


@feature("AC1", "reversal")
def _ac1(b):
    return balanced(b, b.rautocorr(ret(b), 20, 1))


@feature("VOL_RATIO", "volume", True)
def _vol_ratio(b):
    return b.volume / (b.rmean(b.volume, 20) + EPS)


@feature("VOL_Z", "volume")
def _vol_z(b):
    return b.clamp((b.volume - b.rmean(b.volume, 20)) / (b.rstd(b.volume, 20) + EPS + EPS), -5.0, 5.0)


@feature("PV_CORR", "volume")
def _pv_corr(b):
    one, two = FEATURES["RET"].build(b), FEATURES["VOL_RATIO"].build(b)
    return balanced(b, b.rcorr(one, named(b, b.log1p(b.hi2(two, -0.99))), 10))


def relative(name: str) -> tuple[Callable, Callable]:
    """A normalised feature less its cross-section mean, normed again; itself if alone."""

    def raw(b) -> X:
        x = FEATURES[name].build(b)
        return x - b.xs_mean(x)

    def final(b) -> X:
        return b.where(b.symbols() <= 1, FEATURES[name].build(b), b.rn(named(b, raw(b))))

    return raw, final


for _name, _of in (("REL_RET5", "RET5"), ("REL_RET20", "RET20"), ("REL_VOL", "RVOL")):
    _raw, _final = relative(_of)
    FEATURES[_name] = Feature(_name, "cross_sectional", True, _raw, _final)


@feature("VWAP_DEV", "volume", True)
def _vwap_dev(b):
    vwap = named(b, b.rsum(typical(b) * b.volume, 20) / (b.rsum(b.volume, 20) + EPS))
    return deviation(b, b.close, vwap)


def bands(b) -> tuple[X, X, X]:
    mean, std = named(b, b.rmean(b.close, 20)), named(b, b.rstd(b.close, 20) + EPS)
    return mean - 2.0 * std, mean + 2.0 * std, mean


@feature("BOLL_POS", "channel")
def _boll_pos(b):
    lo, up, _ = bands(b)
    return unit(b, (b.close - lo) / (up - lo + EPS))


@feature("BOLL_WIDTH", "volatility", True)
def _boll_width(b):
    lo, up, mean = bands(b)
    return (up - lo) / (mean + EPS)


@feature("MACD_HIST", "momentum", True)
def _macd_hist(b):
    macd = named(b, b.fema(b.close, 12) - b.fema(b.close, 26))
    return macd - b.fema(macd, 9)


@feature("OBV_SLOPE", "volume", True)
def _obv_slope(b):
    flow = named(b, b.sign(b.close - b.prev(b.close)) * b.volume)
    return b.slope(named(b, b.cumsum(flow)), 20)


@feature("MFI14", "volume")
def _mfi14(b):
    tp = typical(b)
    before = named(b, b.prev(tp))
    flow = tp * b.volume
    up, down = b.rsum(b.where(tp > before, flow, 0.0), 14), b.rsum(b.where(tp < before, flow, 0.0), 14)
    return balanced(b, (100.0 - 100.0 / (1.0 + up / (down + EPS)) - 50.0) / 50.0)


@feature("WILLR_14", "reversal")
def _willr(b):
    top, bottom = b.rmax(b.high, 14), b.rmin(b.low, 14)
    return b.clamp((top - b.close) / (top - bottom + EPS), -1.0, 0.0)


@feature("CCI_14", "reversal")
def _cci(b):
    tp = typical(b)
    return balanced(b, (tp - b.rmean(tp, 14)) / (0.015 * b.rmad(tp, 14) + EPS) / 200.0)


@feature("ROC_12", "momentum", True)
def _roc(b):
    return b.where(b.i < 12, 0.0, b.close / (b.lag(b.close, 12) + EPS) - 1.0)


@feature("TYPICAL_DEV", "reversal", True)
def _typical_dev(b):
    tp = typical(b)
    return deviation(b, tp, named(b, b.rmean(tp, 20)))


@feature("EMA_RATIO_12_26", "trend", True)
def _ema_ratio(b):
    return b.fema(b.close, 12) / (b.fema(b.close, 26) + EPS) - 1.0


@feature("TREND_STRENGTH_50", "trend", True)
def _trend_strength(b):
    w = 50
    tvar = w * (w * w - 1) / 12
    mean, top = named(b, b.rmean(b.close, w)), named(b, b.rtrend(b.close, w))
    total = named(b, b.rvar(b.close, w) * w)
    slope = top / (tvar + EPS)
    # residuals around mean + slope * centred place
    left = total - 2.0 * slope * top + slope * slope * tvar
    fit = unit(b, 1.0 - left / (total + EPS))
    return slope / (mean + EPS) * fit


@feature("PRICE_POS_50", "trend")
def _price_pos(b):
    return unit(b, place_in_range(b, 50))


@feature("TRIX_15", "momentum", True)
def _trix15(b):
    return trix(b)


def trix(b) -> X:
    e = b.fema(b.fema(b.fema(b.close, 15), 15), 15)
    before = named(b, b.prev(e))
    return named(b, (e - before) / (b.abs(before) + EPS))


@feature("PPO", "momentum", True)
def _ppo(b):
    fast, slow = b.fema(b.close, 12), b.fema(b.close, 26)
    return (fast - slow) / (b.abs(slow) + EPS)


@feature("ULT_OSC", "momentum")
def _ult_osc(b):
    pc = named(b, b.prev(b.close))
    floor = b.lo2(b.low, pc)
    bought, span = named(b, b.close - floor), named(b, b.hi2(b.high, pc) - floor)
    part = lambda w: b.rsum(bought, w) / (b.rsum(span, w) + EPS)
    return balanced(b, (4.0 * part(7) + 2.0 * part(14) + part(28)) / 7.0 * 2.0 - 1.0)


@feature("RET_ACCEL", "momentum", True)
def _ret_accel(b):
    r = ret(b, 5)
    return r - b.lag(r, 5)


def log_vol(b, x: X, positive: bool = True) -> X:
    """log1p of the root of the 20-bar mean."""
    return b.log1p(b.sqrt(b.rmean(b.hi2(x, 0.0) if positive else x, 20)))


@feature("GK_VOL", "volatility", True)
def _gk(b):
    hl, co = log_ratio(b, b.high, b.low), log_ratio(b, b.close, b.open)
    return log_vol(b, 0.5 * hl * hl - (2.0 * math.log(2.0) - 1.0) * co * co)


@feature("PARKINSON_VOL", "volatility", True)
def _parkinson(b):
    hl = log_ratio(b, b.high, b.low)
    return log_vol(b, hl * hl * (1.0 / (4.0 * math.log(2.0))))


def rogers_satchell(b) -> X:
    up = log_ratio(b, b.high, b.close) * log_ratio(b, b.high, b.open)
    return up + log_ratio(b, b.low, b.close) * log_ratio(b, b.low, b.open)


@feature("YANG_ZHANG_VOL", "volatility", True)
def _yang_zhang(b):
    night = log_ratio(b, b.open, named(b, b.prev(b.close)))
    day = log_ratio(b, b.open, b.close)
    return log_vol(b, (night * night + day * day + b.hi2(rogers_satchell(b), 0.0)) / 3.0)


@feature("RS_VOL", "volatility", True)
def _rs_vol(b):
    return log_vol(b, rogers_satchell(b), False)


@feature("AMIHUD_ILLIQ", "volume", True)
def _amihud(b):
    return b.log1p(b.hi2(b.rmean(b.abs(ret(b)) / (b.volume + EPS), 20), 0.0))


@feature("KYLE_LAMBDA", "volume", True)
def _kyle(b):
    r = ret(b)
    size, flow = named(b, b.abs(r)), named(b, b.sign(r) * b.volume)
    return b.rcov(size, flow, 20) / (b.rvar(flow, 20) + EPS)


@feature("CMF_20", "volume")
def _cmf(b):
    return balanced(b, b.rsum(money_flow(b), 20) / (b.rsum(b.volume, 20) + EPS))


@feature("AD_LINE_SLOPE", "volume", True)
def _ad_slope(b):
    return b.slope(named(b, b.cumsum(money_flow(b))), 20)


@feature("STOCH_K_14", "reversal")
def _stoch_k(b):
    return balanced(b, place_in_range(b, 14) * 2.0 - 1.0)


@feature("STOCH_D_3", "reversal")
def _stoch_d(b):
    return balanced(b, b.rmean(named(b, place_in_range(b, 14)), 3) * 2.0 - 1.0)


@feature("AROON_OSC_25", "reversal")
def _aroon(b):
    return balanced(b, (b.rargmax(b.high, 25) - b.rargmin(b.low, 25)) / 25.0)


def directional(b, w: int = 14) -> tuple[X, X]:
    up = b.hi2(b.high - b.prev(b.high), 0.0)
    down = b.hi2(b.prev(b.low) - b.low, 0.0)
    span = atr(b, w)
    return named(b, b.rmean(named(b, up), w) / (span + EPS)), named(b, b.rmean(named(b, down), w) / (span + EPS))


@feature("DMI_ADX_14", "trend")
def _adx(b):
    up, down = directional(b)
    dx = named(b, b.abs(up - down) / (up + down + EPS))
    return unit(b, b.rmean(dx, 14))


@feature("DMI_DIFF_14", "trend")
def _dmi_diff(b):
    up, down = directional(b)
    return balanced(b, up - down)


@feature("TRIX_SIGNAL", "momentum", True)
def _trix_signal(b):
    t = trix(b)
    return t - b.rmean(t, 9)


@feature("DONCHIAN_POS_20", "channel")
def _donchian(b):
    return unit(b, place_in_range(b, 20))


@feature("KELTNER_POS_20", "channel")
def _keltner(b):
    mid, span = b.fema(b.close, 20), b.fema(atr(b), 20)
    lo, up = mid - 2.0 * span, mid + 2.0 * span
    return unit(b, (b.close - lo) / (up - lo + EPS))


@feature("ICHIMOKU_KIJUN_DEV", "channel", True)
def _kijun(b):
    return deviation(b, b.close, middle(b, 26))


@feature("ICHIMOKU_TENKAN_DEV", "channel", True)
def _tenkan(b):
    return deviation(b, b.close, middle(b, 9))


@feature("SUPERTREND_DIR", "channel")
def _supertrend(b):
    half, span = (b.high + b.low) / 2.0, atr(b)
    up, down = named(b, b.lag(half + 1.5 * span, 1)), named(b, b.lag(half - 1.5 * span, 1))
    later = b.i > 0
    above, below = later & (b.close > up), later & (b.close < down)
    return b.last_set(named(b, above | below), named(b, b.where(below, -1.0, 1.0)), 0.0)


@feature("SAR_DIST", "channel", True)
def _sar(b):
    return b.fema(b.close, 20) - b.fema(b.close, 50)


@feature("ROLL_SKEW_20", "statistical", True)
def _skew(b):
    r = ret(b)
    std = b.sqrt(b.rmoment(r, 20, 2))
    return b.rmoment(r, 20, 3) / (std * std * std + EPS)


@feature("ROLL_KURT_20", "statistical", True)
def _kurt(b):
    r = ret(b)
    var = b.rmoment(r, 20, 2)
    return b.rmoment(r, 20, 4) / (var * var + EPS) - 3.0


@feature("HURST_50", "statistical")
def _hurst(b):
    r = ret(b)
    span, std = named(b, b.rwander(r, 50)), named(b, b.sqrt(b.rmoment(r, 50, 2)))
    still = (span < EPS) | (std < EPS)
    h = b.ln(b.where(still, 1.0, span) / (b.where(still, 1.0, std) + EPS) + EPS) / math.log(50)
    return b.where(still, 0.0, unit(b, h) * 2.0 - 1.0)


@feature("FRACTAL_DIM_30", "statistical")
def _fractal(b):
    span = b.rmax(b.close, 30) - b.rmin(b.close, 30)
    step = named(b, b.abs(b.close - b.prev(b.close)))
    return b.clamp(span / (b.rmean(step, 30) * math.sqrt(30) + EPS), 0.0, 3.0) / 3.0 * 2.0 - 1.0


@feature("AC2", "statistical")
def _ac2(b):
    return balanced(b, b.rautocorr(ret(b), 20, 2))


@feature("RET_ENTROPY_20", "statistical")
def _entropy(b):
    r = ret(b)
    up, down = b.rsum(b.where(r > 0, 1.0, 0.0), 20) / 20.0, b.rsum(b.where(r < 0, 1.0, 0.0), 20) / 20.0
    h = lambda p: -(p * b.ln(p + EPS))
    return unit(b, (h(up) + h(down) + h(1.0 - up - down)) / math.log(3))


def _cs_rank(b):
    r = ret(b, 5)
    n = b.symbols()
    return b.xs_place(r) / b.where(n <= 1, 1.0, n - 1.0)


FEATURES["CS_RANK_RET5"] = Feature(
    "CS_RANK_RET5", "cross_sectional", False, _cs_rank, lambda b: b.where(b.symbols() <= 1, b.rn(ret(b, 5)), _cs_rank(b))
)


def _cs_zscore(b):
    r = ret(b, 20)
    std = b.xs_std(r)
    return (r - b.xs_mean(r)) / (b.where(b.symbols() <= 1, 1.0, std) + EPS)


FEATURES["CS_ZSCORE_RET20"] = Feature(
    "CS_ZSCORE_RET20",
    "cross_sectional",
    True,
    _cs_zscore,
    lambda b: b.where(b.symbols() <= 1, b.rn(ret(b, 20)), b.rn(named(b, _cs_zscore(b)))),
)

#: The order of the vocabulary.
ORDER = (
    "RET RET5 RET20 MA_DIFF SLOPE20 ATR RVOL HL_RANGE VOL_REGIME DEV DEV60 RSI14 PRESSURE AC1 VOL_RATIO VOL_Z PV_CORR "
    "REL_RET5 REL_RET20 REL_VOL VWAP_DEV BOLL_POS BOLL_WIDTH MACD_HIST OBV_SLOPE MFI14 WILLR_14 CCI_14 ROC_12 "
    "TYPICAL_DEV EMA_RATIO_12_26 TREND_STRENGTH_50 PRICE_POS_50 TRIX_15 PPO ULT_OSC RET_ACCEL GK_VOL PARKINSON_VOL "
    "YANG_ZHANG_VOL RS_VOL AMIHUD_ILLIQ KYLE_LAMBDA CMF_20 AD_LINE_SLOPE STOCH_K_14 STOCH_D_3 AROON_OSC_25 DMI_ADX_14 "
    "DMI_DIFF_14 TRIX_SIGNAL DONCHIAN_POS_20 KELTNER_POS_20 ICHIMOKU_KIJUN_DEV ICHIMOKU_TENKAN_DEV SUPERTREND_DIR "
    "SAR_DIST ROLL_SKEW_20 ROLL_KURT_20 HURST_50 FRACTAL_DIM_30 AC2 RET_ENTROPY_20 CS_RANK_RET5 CS_ZSCORE_RET20"
).split()
FEATURES = {n: FEATURES[n] for n in ORDER}
