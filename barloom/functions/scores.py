"""Row scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barloom.functions.columns import clip, ratio


def rule_score(vol: Column, volume_ratio: Column, filters: Column, fixed_cost: float = 0.0015) -> Column:
    """P_rb = W * filters - costs - risk over a whole table; -1 until the inputs exist."""
    w = 0.5 * clip(vol / 0.05, 0, 1) + 0.5 * clip(volume_ratio, 0, 2) / 2
    return F.coalesce(w * filters - fixed_cost - clip(vol * 2.0, 0, 0.5), F.lit(-1.0))


def hybrid_simple(fast: Column, slow: Column, rsi: Column, close: Column, lower: Column, upper: Column) -> Column:
    """Trend 0.4, mean reversion 0.4, momentum 0.2; unknown inputs read as down or neutral."""
    trend = F.when(fast > slow, 1.0).otherwise(-1.0)
    by_rsi = F.when(rsi < 30, 1.0).when(rsi > 70, -1.0).otherwise(0.0)
    by_band = F.when(close < lower, 1.0).when(close > upper, -1.0).otherwise(0.0)
    momentum = F.when(close > slow, 1.0).otherwise(-1.0)
    return 0.4 * trend + 0.4 * (0.5 * by_rsi + 0.5 * by_band) + 0.2 * momentum


# ---------------------------------------------------------------- opportunity

# Sensitivity of the volatility score by regime.
LAMBDA = {"low_vol": 15.0, "normal": 10.0, "high_vol": 6.0, "crisis": 3.0}


def by_key(table: dict, key: Column, default) -> Column:
    entries = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def volatility_opportunity(sigma: Column, regime: Column, crisis: Column) -> Column:
    return clip((1 - F.exp(-by_key(LAMBDA, regime, 10.0) * sigma)) * (1 - crisis), 0, 1)


def liquidity_opportunity(bids: Column, asks: Column, sensitivity: float = 100.0, typical: float = 10.0) -> Column:
    """Spread 0.4, depth of ten levels 0.4, balance 0.2; 0 without a two-sided book."""
    def depth(side):
        return F.aggregate(F.slice(side, 1, 10), F.lit(0.0), lambda a, x: a + x["size"])
    bid, ask = F.try_element_at(bids, F.lit(1))["price"], F.try_element_at(asks, F.lit(1))["price"]
    mid, total = (bid + ask) / 2, depth(bids) + depth(asks)
    spread = F.when(mid > 0, ratio(ask - bid, mid)).otherwise(1.0)
    balance = F.when(total > 0, 1 - F.abs(ratio(depth(bids) - depth(asks), total))).otherwise(1.0)
    score = 0.4 * (1 - F.tanh(sensitivity * spread)) + 0.4 * F.least(F.lit(1.0), total / typical) + 0.2 * balance
    return F.when((F.size(bids) > 0) & (F.size(asks) > 0), clip(score, 0, 1)).otherwise(0.0)


def microstructure(autocorr: Column, volume: Column, volume_ma: Column) -> Column:
    efficiency = F.coalesce(F.exp(-F.abs(autocorr)), F.lit(0.5))
    steady = F.when(volume_ma > 0, clip(1 - F.abs(F.log(ratio(volume, volume_ma))) / 2, 0, 1)).otherwise(0.5)
    return clip(efficiency * F.coalesce(steady, F.lit(0.0)), 0, 1)


def weighted_opportunity(vol: Column, liq: Column, micro: Column) -> Column:
    return clip(0.40 * vol + 0.35 * liq + 0.25 * micro, 0, 1)


def simple_opportunity(rsi, volume_ratio, ema_fast, ema_slow, atr_pct) -> dict[str, Column]:
    """Base 0.5 moved by oversold, volume, trend and volatility factors."""
    oversold = F.when(rsi < 30, (30 - rsi) / 30).otherwise(0.0)
    volume = (F.when(volume_ratio.between(1.5, 3.0), 1 - F.abs(volume_ratio - 2.0) / 1.5)
              .when(volume_ratio > 5.0, -F.least(F.lit(0.2), (volume_ratio - 5.0) / 10.0)).otherwise(0.0))
    volume_weight = F.when(volume_ratio > 5.0, 1.0).otherwise(0.15)
    r = F.when(ema_slow > 0, ratio(ema_fast, ema_slow)).otherwise(1.0)
    trend = F.when(r > 1.0, F.least(F.lit(0.1), (r - 1.0) * 2.0)).otherwise(-F.least(F.lit(0.05), 1.0 - r))
    calm = F.when(atr_pct < 0.03, 0.1).when(atr_pct > 0.08, -F.least(F.lit(0.15), (atr_pct - 0.08) / 0.1)).otherwise(0.0)
    score = clip(0.5 + oversold * 0.25 + volume * volume_weight + trend + calm, 0, 1)
    label = F.when(score >= 0.7, "EXCELLENT").when(score >= 0.5, "GOOD").when(score >= 0.3, "MODERATE").otherwise("LOW")
    return {"oversold": oversold, "volume_factor": volume, "trend_factor": trend, "calm_factor": calm, "opportunity": score, "label": label}


def gated_score(p, volume, intrabar, regime, crisis, volume_min, volatility_max, threshold=0.5, crisis_penalty=1.0) -> Column:
    factor = by_key({"bull": 1.2, "sideways": 1.0, "bear": 0.8}, regime, 1.0)
    return F.when((p < threshold) | (volume < volume_min) | (intrabar > volatility_max), 0.0).otherwise(
        p * factor * F.when(crisis, 1.0 - crisis_penalty).otherwise(1.0))


def volume_bucket(bar_idx, volume, recent) -> Column:
    return F.when(bar_idx < 20, 1.0).when(volume < recent * 0.5, 0.5).when(volume > recent * 1.5, 1.2).otherwise(1.0)


# ---------------------------------------------------------------- costs and risk

def round_trip_cost(maker: float = 0.001, slippage: float = 0.0005) -> float:
    return 2 * (maker + slippage)


def volume_cost(volume, typical, commission=0.001, slippage=0.0005) -> Column:
    thin = (typical > 0) & (volume < typical * 0.5)
    return F.lit(commission * 2 + slippage) + F.when(thin, 0.0005).otherwise(0.0)


def adaptive_cost(vol, commission=0.001, slippage=0.0005, beta=2.0) -> Column:
    return (commission + slippage) * (1 + beta * vol)


def transaction_cost(size, vol, slippage, fee=0.001) -> Column:
    return fee * F.abs(size) + slippage * (vol / 0.02)


def switching_cost(before, after, penalty=0.01) -> Column:
    """Sum of position changes over the union of assets in two maps."""
    changes = F.map_zip_with(before, after, lambda _, a, b: F.abs(F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0))))
    return penalty * F.aggregate(F.map_values(changes), F.lit(0.0), lambda s, x: s + x)


def additive_penalty(atr_pct, volume_ratio, crisis_level, ood) -> Column:
    return (
        F.when(atr_pct > 0.05, F.least(F.lit(0.01), (atr_pct - 0.05) / 0.05)).otherwise(0.0)
        + F.when(volume_ratio < 0.5, F.least(F.lit(0.015), (0.5 - volume_ratio) / 0.5)).otherwise(0.0)
        + F.when(crisis_level > 3, F.least(F.lit(0.03), (crisis_level - 3) * 0.01)).otherwise(0.0)
        + F.when(ood > 0.5, F.least(F.lit(0.005), ood - 0.5)).otherwise(0.0))


def two_term_penalty(vol_pct, p, limit=0.05) -> Column:
    high = F.when(vol_pct > limit, F.least(F.lit(0.5), 0.1 * vol_pct / limit)).otherwise(0.0)
    return F.least(F.lit(1.0), high + F.when(p < 0.55, (0.55 - p) * 0.2).otherwise(0.0))


# Weights and regime multipliers of the five risk parts.
RISK_WEIGHTS = {"vol": 0.30, "tail": 0.20, "liq": 0.20, "ood": 0.15, "dd": 0.15}
RISK_REGIME = {"BULL": 1.0, "BEAR": 1.5, "SIDEWAYS": 1.2, "CRISIS": 3.0}


def total_risk(garch_var, cvar, spread, atr, mahalanobis, drawdown, regime) -> dict[str, Column]:
    """Five risk parts and their weighted sum; an unknown distance counts 0."""
    m = by_key(RISK_REGIME, regime, 1.0)
    parts = {
        "r_vol": 10.0 * F.sqrt(garch_var) * m, "r_tail": F.abs(cvar),
        "r_liq": 5.0 * F.when(atr == 0, 0.0).otherwise(ratio(spread, atr)),
        "r_ood": F.coalesce(mahalanobis / 3.0, F.lit(0.0)),
        "r_dd": F.when(drawdown <= 0, 0.0).otherwise(F.exp(5.0 * drawdown / 0.15) - 1)}
    total = sum((RISK_WEIGHTS[k] * parts[f"r_{k}"] for k in ("tail", "liq", "ood", "dd")), RISK_WEIGHTS["vol"] * parts["r_vol"])
    return {**parts, "risk": total * m}


# ---------------------------------------------------------------- decisions

def heuristic_probability(rsi_pctile) -> Column:
    return clip(1 / (1 + F.exp(-5 * (F.abs(rsi_pctile - 0.5) - 0.3))), 0.3, 0.7)


def ml_gate(crisis, drawdown, regime) -> Column:
    return ((crisis < 0.7) & (drawdown < 0.20) & F.lower(regime).isin("normal", "bull", "recovery")).cast("int")


def add_adaptive_weights(df, n, mean_a, sd_a, mean_b, sd_b, gamma=0.10, names=("alpha", "beta")):
    """Softmax of two population Sharpe ratios; defaults below five observations.
    Worked out column by column so that no expression is repeated."""
    free = 1 - gamma
    def e(mean, sd):
        return F.exp(F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise(ratio(mean, sd)) + 1e-6)
    df = df.withColumns({"_ea": e(mean_a, sd_a), "_eb": e(mean_b, sd_b)})
    df = df.withColumn("_share", F.col("_ea") / (F.col("_ea") + F.col("_eb")))
    df = df.withColumns({"_wa": clip(F.col("_share") * free, 0.1, 0.8), "_wb": clip((1 - F.col("_share")) * free, 0.1, 0.8)})
    df = df.withColumn("_scale", F.least(F.lit(1.0), free / (F.col("_wa") + F.col("_wb"))))
    out = {m: F.when(n < 5, 0.45).otherwise(F.col(w) * F.col("_scale")) for m, w in zip(names, ("_wa", "_wb"))}
    return df.withColumns(out).drop("_ea", "_eb", "_share", "_wa", "_wb", "_scale")


def future_value(regime, crisis, gamma=0.95) -> Column:
    return gamma * F.when((regime == "crisis") | (crisis > 0.5), 0.01).otherwise(0.05)


RISK_AVERSION = {"BULL": 0.3, "BEAR": 0.8, "SIDEWAYS": 0.5}
VOL_AVERSION = {"LOW": 0.7, "NORMAL": 1.0, "HIGH": 1.5}
REGIME_RETURN = {"BULL": 0.02, "BEAR": -0.01, "SIDEWAYS": 0.003}


def decision_score(base, passed, opp, c_trans, c_switch, regime_conf, quality, regime, vol_regime, transitions, gamma=0.95, periods=24):
    """Score, action and size of the layered decision formula."""
    unsure = clip((1 - base) * 0.5 + (1 - regime_conf) * 0.3 + (1 - quality) * 0.2, 0, 1)
    lam = by_key(RISK_AVERSION, regime, 0.5) * by_key(VOL_AVERSION, vol_regime, 1.0)
    forward = F.aggregate(F.map_entries(transitions), F.lit(0.0), lambda s, e: s + e["value"] * by_key(REGIME_RETURN, e["key"], 0.0)) * gamma ** periods
    raw = base * clip(0.1 + opp * 1.4, 0.1, 1.5) - c_trans - c_switch - lam * unsure + gamma * forward
    score = clip(F.when(passed, raw).otherwise(0.0), -1, 2)
    action = F.when(score <= 0, "HALT").when(score < 0.3, "REDUCE").when(score < 0.6, "SMALL_TRADE").otherwise("TRADE")
    size = F.when(score <= 0, 0.0).when(score < 0.3, 0.02).when(score < 0.6, 0.05).otherwise(0.10)
    return {"uncertainty": unsure, "lambda": lam, "forward_value": forward, "score": score, "action": action, "size": size}


def governance(crisis_type, crisis_conf, daily_pnl, drawdown, corr, bot_prob, vol, base_vol, news, sentiment, opp, equity, avg_corr, n_open):
    """Halt rules in order, override, size multiplier, position cap and emergency stop.

    The last halt rule that fires sets the halt's length."""
    bot = bot_prob > 0.5
    rules = [
        ("CRASH_DETECTED", (crisis_type == "CRASH") & (crisis_conf >= 0.9), 24), ("MAX_DRAWDOWN", daily_pnl <= -5.0, 12),
        ("MAX_DRAWDOWN", drawdown >= 10.0, 12), ("CORRELATION_SPIKE", corr >= 0.85, 6),
        ("BOT_MANIPULATION", bot & (bot_prob >= 0.8) & (crisis_type == "MANIPULATION"), 2), ("EXTREME_VOLATILITY", vol >= base_vol * 3.0, 4),
        ("NEGATIVE_CRITICAL_NEWS", (news == "CRITICAL") & (sentiment < 0.3), 6)]
    reasons = F.array_compact(F.array(*[F.when(c, n) for n, c, _ in rules]))
    hours = F.coalesce(*[F.when(c, h) for _, c, h in reversed(rules)])
    halted = F.size(reasons) > 0
    wary = (opp >= 0.8) & bot & (bot_prob >= 0.7)
    crisis_opp = crisis_type.isin("CRASH", "MANIPULATION") & (opp >= 0.6)
    state = F.when(halted, "HALTED").when(wary | crisis_opp, "REDUCED").otherwise("ACTIVE")
    tier = F.when(opp >= 0.8, 0.8 + (opp - 0.8)).when(opp >= 0.6, 0.5 + (opp - 0.6) * 1.5).when(
        opp >= 0.4, 0.2 + (opp - 0.4) * 1.5).otherwise(F.greatest(F.lit(0.0), opp * 0.5))
    used = F.abs(daily_pnl) / 5.0
    active = tier * F.when(vol > base_vol * 2.0, 0.5).otherwise(1.0) * F.when(used > 0.5, 1 - used).otherwise(1.0)
    mult = F.when(halted, 0.0).when(crisis_opp, 0.2).when(wary, 0.3).otherwise(active)
    cap = equity * 0.2 * mult * F.when(avg_corr >= 0.7, 1 - (avg_corr - 0.7) / 0.3 * 0.5).otherwise(1.0)
    cap = cap * F.when(n_open >= 5, 0.7).otherwise(1.0) * F.when(n_open >= 8, 0.5).otherwise(1.0)
    vr = vol / base_vol
    stop = by_key({"CRASH": 5.0, "MANIPULATION": 8.0, "GLITCH": 15.0, "OPPORTUNITY": 10.0}, crisis_type, 10.0)
    stop = clip(stop * F.when(vr > 2.0, 1.5).when(vr < 0.5, 0.7).otherwise(1.0), 3, 20)
    return {"reasons": reasons, "halt_hours": hours, "state": state, "multiplier": mult, "max_position": cap, "stop_pct": stop}


def confluence(bar_idx, rsi, volume_ratio, close, support, past_close, ma20, ma200, accumulation, low20) -> Column:
    score = (
        F.lit(0.25) + F.when(rsi < 25, 0.10).otherwise(0.0)
        + F.when((volume_ratio > 0.8) & (volume_ratio < 1.2), 0.20).when(volume_ratio > 1.5, -0.15).otherwise(0.0)
        + F.when(ratio(close - support, support) < 0.02, 0.15).otherwise(0.0) + F.when((rsi < 30) & (close > past_close), 0.20).otherwise(0.0)
        + F.when(accumulation & (low20 < support) & (close > support), 0.25).otherwise(0.0) + F.when(ma20 > ma200, 0.10).otherwise(0.0))
    return F.when((bar_idx >= 199) & (rsi < 30), F.least(score, F.lit(1.0))).otherwise(0.0)


def agreement(*values) -> Column:
    n = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    return F.when(n < 2, 1.0).otherwise(1 - F.least(F.greatest(*values) - F.least(*values), F.lit(1.0)))


def position_size(method, capital, price, stop, atr, win_rate, win_loss, strength, fixed=0.95, risk=0.02, kelly=0.25, cap=0.95) -> Column:
    flat = capital * fixed / price
    by_risk = F.when(stop.isNull() | (stop >= price), flat).otherwise(ratio(capital * risk, F.abs(price - stop)))
    share = F.least(F.greatest(F.lit(0.0), ratio(win_rate * win_loss - (1 - win_rate), win_loss) * kelly), F.lit(cap))
    ok = (win_rate > 0) & (win_rate < 1) & (win_loss > 0)
    by_kelly = F.when(ok, capital * share / price).otherwise(flat)
    by_atr = F.when(atr > 0, ratio(capital * risk, atr * 2.0)).otherwise(flat)
    raw = F.when(method == "risk_based", by_risk).when(method == "kelly", by_kelly).when(method == "atr_based", by_atr).otherwise(flat)
    return F.greatest(F.lit(0.0), F.least(raw * strength, capital * cap / price))


def trade_check(position_pct, exposure_pct, drawdown, n_open, max_pos=0.1, max_exposure=0.5, max_dd=0.2, max_open=5) -> Column:
    """Reason of the first failing check, OK when none fails."""
    return (F.when(position_pct > max_pos, "POSITION_TOO_LARGE").when(exposure_pct > max_exposure, "EXPOSURE_TOO_HIGH")
            .when(drawdown < -max_dd, "DRAWDOWN_TOO_LARGE").when(n_open >= max_open, "TOO_MANY_TRADES").otherwise("OK"))


def bot_type(probability, latency, imbalance, volume_ratio) -> Column:
    return F.when(probability > 0.5, F.when(latency > 0.6, "latency_arbitrage").when(imbalance > 0.7, "spoofing").when(
        volume_ratio > 5, "wash_trading").otherwise("front_running"))


def rule_entry(rsi, ema_ratio, volume_ratio, atr_pct, rsi_below=30.0, ema_least=1.0, volume_least=1.5, atr_most=0.05) -> Column:
    """Improved rule entry: every condition that is switched on has to hold; None switches one off, an unknown value fails it."""
    held = F.lit(True)
    for on, holds in ((rsi_below, lambda x: rsi < x), (ema_least, lambda x: ema_ratio >= x), (volume_least, lambda x: volume_ratio >= x), (atr_most, lambda x: atr_pct <= x)):
        if on is not None:
            held = held & F.coalesce(holds(on), F.lit(False))
    return held
