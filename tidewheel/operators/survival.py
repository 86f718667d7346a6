"""Survival estimates from risk tables: one aggregate by time, then sums over distinct times.

Data come as (entity_id, time, event 0/1, group).  A risk table has a row for each distinct time of a
group; what is summed up over times goes through range partitions of (group, time), so a group with most rows is many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.special import chi2_tail, normal_two_sided, t_two_sided
from tidewheel.operators.shared import free, save
from tidewheel.operators.stats import average_ranks, running_counts, running_sums

c, lit = F.col, F.lit
HORIZONS = (30, 90, 180, 365)


def prepare(df: DataFrame, event: Column, time: str, max_time: float | None = None) -> DataFrame:
    """Add ``time`` and ``event``: missing events are none, and times above ``max_time`` are censored there."""
    out = df.where(c(time).isNotNull()).withColumns({"event": F.coalesce(event.cast("int"), lit(0)), "time": c(time).cast("double")})
    if max_time is not None:
        out = out.withColumns({"event": F.when(c("time") > max_time, 0).otherwise(c("event")), "time": F.least("time", lit(float(max_time)))})
    return out


def risk_table(df: DataFrame, group: str) -> DataFrame:
    """(group, time, deaths, at_risk)."""
    t = running_sums(df, "time", {"leaving": F.count("*"), "deaths": F.sum("event")}, (group,), descending=True)
    return t.select(group, "time", "deaths", (c("leaving") + c("leaving_before")).alias("at_risk"), "leaving")


def kaplan_meier(df: DataFrame, group: str, least: int = 2) -> DataFrame:
    """(group, time, at_risk, deaths, survival, low, high): log-log 95 % limits; groups below ``least`` are left out."""
    r = risk_table(df, group)
    sizes = r.groupBy(c(group).alias("_g")).agg(F.max("at_risk").alias("_n"))  # a row for each group
    d, n = c("deaths"), c("at_risk")
    terms = {"log": F.coalesce(F.ln(F.nullif(1 - d / n, lit(0.0))), lit(0.0)), "v": F.coalesce(d / F.nullif(n * (n - d), lit(0)), lit(0.0)), "end": (d == n).cast("int")}
    sums = running_sums(r, "time", {"deaths": F.max("deaths"), "at_risk": F.max("at_risk")} | {x: F.sum(e) for x, e in terms.items()}, (group,))
    upto = lambda x: c(x) + c(f"{x}_before")
    s = F.when(upto("end") > 0, 0.0).otherwise(F.exp(upto("log")))
    out = sums.join(sizes, c(group).eqNullSafe(c("_g"))).withColumns({"survival": s, "_v": upto("v")}).where(c("_n") >= least)
    inside = (c("survival") > 0) & (c("survival") < 1)
    se = F.sqrt("_v") / F.abs(F.ln(F.when(inside, c("survival"))))
    limit = lambda sign: F.when(inside, F.pow(c("survival"), F.exp(sign * 1.959963984540054 * se))).otherwise(c("survival"))
    return out.select(group, "time", "at_risk", "deaths", "survival", limit(1).alias("low"), limit(-1).alias("high"))


def median_survival(km: DataFrame, group: str) -> DataFrame:
    """The first time with a survival of one half or less, up to rounding."""
    return km.groupBy(group).agg(F.min(F.when(c("survival") <= 0.5 + 1e-9, c("time"))).alias("median"))


def survival_at(df: DataFrame, group: str, horizons: tuple = HORIZONS) -> DataFrame:
    """Per group: n, events, rate and the survival at each horizon (1 before the first time)."""
    km = kaplan_meier(df, group, 1)
    cells = [F.coalesce(F.max_by(F.when(c("time") <= h, c("survival")), F.when(c("time") <= h, c("time"))), lit(1.0)).alias(f"survival_{h}") for h in horizons]
    return df.groupBy(group).agg(F.count("*").alias("n"), F.sum("event").alias("events"), F.avg("event").alias("rate")).join(km.groupBy(group).agg(*cells), group)


def log_rank(df: DataFrame, group: str) -> dict[str, float]:
    """Multivariate log-rank test: statistic, dof, p_value.  What is collected has a row for each pair of groups."""
    r = risk_table(df, group)
    names = [x[0] for x in r.select(group).distinct().orderBy(group).collect()]
    # At a time of another group's event a group has those at risk who leave then or later.
    times = r.groupBy("time").agg(F.sum("deaths").alias("d")).where("d > 0")
    pairs = times.join(F.broadcast(r.select(group).distinct()))
    merged = pairs.join(r, [group, "time"], "left").select(group, "time", "d", F.coalesce("deaths", lit(0)).alias("own"), c("leaving"))
    more = merged.unionByName(r.join(times, "time", "left_anti").select(group, "time", lit(None).cast("bigint").alias("d"), lit(0).cast("bigint").alias("own"), "leaving"))
    sums = running_sums(more, "time", {"leaving": F.coalesce(F.sum("leaving"), lit(0)), "d": F.max("d"), "own": F.max("own")}, (group,), descending=True)
    risk = sums.where("d IS NOT NULL").select(c(group).alias("g"), "time", "d", "own", (c("leaving") + c("leaving_before")).alias("y"))
    at = risk.groupBy("time").agg(F.sum("y").alias("n"))
    risk = risk.join(at, "time").select("g", "time", c("d").cast("double"), c("own").cast("double"), c("y").cast("double"), c("n").cast("double"))
    v = c("d") * (c("n") - c("d")) / F.nullif(c("n") * c("n") * (c("n") - 1), lit(0.0))
    first = risk.groupBy("g").agg(F.sum(c("own") - c("d") * c("y") / c("n")).alias("z"), F.sum(v * c("y") * c("n")).alias("diag")).collect()
    cross = risk.alias("a").join(risk.alias("b"), "time").groupBy(c("a.g").alias("g"), c("b.g").alias("h")).agg(F.sum(c("a.d") * (c("a.n") - c("a.d")) / F.nullif(c("a.n") * c("a.n") * (c("a.n") - 1), lit(0.0)) * c("a.y") * c("b.y")).alias("x")).collect()
    at_ = {n: i for i, n in enumerate(names)}
    z, cov = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for x in first:
        z[at_[x["g"]]] = x["z"] or 0
        cov[at_[x["g"]], at_[x["g"]]] += x["diag"] or 0
    for x in cross:
        cov[at_[x["g"]], at_[x["h"]]] -= x["x"] or 0
    k = len(names) - 1
    stat = float(z[:k] @ np.linalg.pinv(cov[:k, :k]) @ z[:k]) if k > 0 else 0.0
    return {"statistic": stat, "dof": k, "p_value": float(chi2_tail(stat, k)) if k > 0 else 1.0}


def cox(df: DataFrame, covariates: list[str], penalty: float = 0.0, most_steps: int = 25, with_concordance: bool = True) -> dict:
    """Cox proportional hazards with Efron ties, by Newton steps.

    The rows are written once.  Each step is one aggregate by time, whose risk-set sums of w, wx and wxx' go through range partitions of
    the distinct times.  Only gradient and Hessian reach the driver.  The concordance, whose work grows faster than the rows, can be left out.
    """
    held = save(_complete(df, covariates), "cox")
    row = held.agg(*[F.avg(x).alias(x) for x in covariates], F.count("*").alias("n")).first()
    own = held.select("time", "event", *[(c(x) - lit(row[x])).alias(x) for x in covariates])
    p, beta, ll = len(covariates), np.zeros(len(covariates)), None
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(most_steps):
        w = F.exp(sum((c(x) * lit(float(b)) for x, b in zip(covariates, beta, strict=True)), lit(0.0)))
        terms = {"w": w} | {f"x{i}": w * c(x) for i, x in enumerate(covariates)} | {f"h{i}_{j}": w * c(covariates[i]) * c(covariates[j]) for i, j in pairs}
        died = c("event") == 1
        dead = lambda e: F.sum(F.when(died, e).otherwise(0.0))
        totals = {"d": F.sum(died.cast("int")), "lw": dead(F.ln(w))} | {f"s{i}": dead(c(x)) for i, x in enumerate(covariates)} | {f"a_{n}": F.sum(e) for n, e in terms.items()} | {f"d_{n}": dead(e) for n, e in terms.items()}
        t = running_sums(own, "time", totals, descending=True).where("d > 0")
        kept = ["d", "lw", *[f"s{i}" for i in range(p)], *[f"d_{n}" for n in terms]]
        risk = save(t.select(*kept, *[(c(f"a_{n}") + c(f"a_{n}_before")).alias(f"r_{n}") for n in terms]), "risk")
        # Efron: the l-th of d tied deaths sees the risk set less l/d of the tied ones; the terms of a time are summed up in place.
        shares = F.transform(F.sequence(lit(0), c("d").cast("int") - 1), lambda l: l / c("d"))
        part = lambda n, f: c(f"r_{n}") - f * c(f"d_{n}")
        over = lambda term: F.sum(F.aggregate(shares, lit(0.0), lambda s, f: s + term(f)))
        sums = risk.agg(
            over(lambda f: F.ln(part("w", f))).alias("l"), *[over(lambda f, i=i: part(f"x{i}", f) / part("w", f)).alias(f"g{i}") for i in range(p)],
            *[over(lambda f, i=i, j=j: part(f"h{i}_{j}", f) / part("w", f) - part(f"x{i}", f) * part(f"x{j}", f) / part("w", f) ** 2).alias(f"i{i}_{j}") for i, j in pairs],
        ).first()
        tops = risk.agg(F.sum("lw").alias("l"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(p)]).first()
        free(risk)
        if sums["l"] is None:
            break
        new = tops["l"] - sums["l"] - penalty / 2 * float(beta @ beta)
        grad = np.array([tops[f"s{i}"] - sums[f"g{i}"] for i in range(p)]) - penalty * beta
        info = np.zeros((p, p))
        for i, j in pairs:
            info[i, j] = info[j, i] = sums[f"i{i}_{j}"]
        info += penalty * np.eye(p)
        step = np.linalg.lstsq(info, grad, rcond=None)[0]
        done = ll is not None and abs(new - ll) < 1e-9 * (1 + abs(new))
        ll = new
        if done:
            break
        beta = beta + step
    found = concordance(held, dict(zip(covariates, beta.tolist(), strict=True))) if with_concordance else None
    free(held)
    se = np.sqrt(np.diag(np.linalg.pinv(info))) if ll is not None else np.full(p, np.nan)
    z = beta / se
    return {
        "coefficients": dict(zip(covariates, beta.tolist(), strict=True)), "hazard_ratios": dict(zip(covariates, np.exp(beta).tolist(), strict=True)), "se": dict(zip(covariates, se.tolist(), strict=True)),
        "low": dict(zip(covariates, np.exp(beta - 1.96 * se).tolist(), strict=True)), "high": dict(zip(covariates, np.exp(beta + 1.96 * se).tolist(), strict=True)),
        "p_values": dict(zip(covariates, normal_two_sided(z).tolist(), strict=True)), "log_likelihood": ll, "aic": None if ll is None else 2 * p - 2 * ll, "n": row["n"], "concordance": found,
    }


def _complete(df: DataFrame, covariates: list[str]) -> DataFrame:
    """(time, event, covariates as doubles) of the complete rows."""
    return df.dropna(subset=["time", "event", *covariates]).select("time", "event", *[c(x).cast("double").alias(x) for x in covariates])


def concordance(df: DataFrame, coefficients: dict[str, float]) -> float:
    """``concordance_table`` for the risk of a linear predictor; NaN without a comparable pair."""
    risk = sum((c(x) * lit(float(b)) for x, b in coefficients.items()), lit(0.0))
    row = concordance_table(df.dropna(subset=["time", "event", *coefficients]).select("time", "event", risk.alias("risk")), "risk").first()
    return float("nan") if row["concordance"] is None else float(row["concordance"])


def concordance_table(df: DataFrame, risk: str) -> DataFrame:
    """One row: concordant, tied, pairs, concordance; exact at any size.

    A pair is comparable if the one with the shorter time had the event; of equal times one with and one without it.
    It is concordant if that one has the greater risk, and counts half if the risks are equal.

    Two ranks differ first in one of their bits.  So a row enters, for every bit of its risk's rank, a cell of the higher bits: events with a 1
    there meet the later rows with a 0 there.  All cells are summed up over time at once, through range partitions of (bit, higher bits, time).
    """
    rows = df.where(c("time").isNotNull() & c("event").isNotNull() & c(risk).isNotNull())
    own = rows.groupBy(F.struct("time", (c("event") != 1).cast("int").alias("left")).alias("at"), c(risk).alias("_risk")).agg(F.count("*").alias("w"))
    own = save(own, "cells")  # a risk made again may differ in its last bit and would find no rank
    ranks = running_counts(own, "_risk", (), c("w")).select("_risk", c("before").alias("rank"))
    own = save(own.join(ranks, "_risk").select("at", "rank", "w"), "ranks")
    bits = int(own.agg(F.max("rank")).first()[0] or 0).bit_length()
    died = F.when(c("at.left") == 0, c("w")).otherwise(0)
    # Bit -1: rows of equal risk.  Bit -2: all comparable pairs.
    cell = lambda bit, key, low, high: F.struct(bit.alias("bit"), key.alias("key"), low.alias("low"), high.alias("high"))
    one = lambda b: F.shiftright("rank", b).bitwiseAND(lit(1)) == 1
    by_bit = [cell(lit(b), F.shiftright("rank", b + 1), F.when(one(b), 0).otherwise(c("w")), F.when(one(b), died).otherwise(0)) for b in range(bits)]
    cells = own.select("at", F.inline(F.array(*by_bit, cell(lit(-1), c("rank"), c("w"), died), cell(lit(-2), lit(0).cast("long"), c("w"), died))))
    sums = running_sums(cells, "at", {"low": F.sum("low"), "high": F.sum("high")}, ("bit", "key"), descending=True)
    met = c("high").cast("decimal(38,0)") * c("low_before")
    total = lambda where: F.coalesce(F.sum(F.when(where, met)), lit(0))
    out = sums.where("high > 0").agg(total(c("bit") >= 0).alias("concordant"), total(c("bit") == -1).alias("tied"), total(c("bit") == -2).alias("pairs"))
    share = (c("concordant") + c("tied") / 2).cast("double") / F.nullif(c("pairs").cast("double"), lit(0.0))
    return out.select(*[c(x).cast("decimal(38,0)").alias(x) for x in ("concordant", "tied", "pairs")], share.alias("concordance"))


def proportional_hazards(df: DataFrame, coefficients: dict[str, float]) -> DataFrame | None:
    """(covariate, r, n, p_value): the correlation of Schoenfeld residuals with the rank of their times; None without enough events.

    A residual is a covariate less its mean in the risk set, weighted by risk; it needs one aggregate by time and running sums.  The rows are written once.
    """
    names = list(coefficients)
    own = save(_complete(df, names), "hazards")
    w = F.exp(sum((c(x) * lit(float(b)) for x, b in coefficients.items()), lit(0.0)))
    t = running_sums(own, "time", {"w": F.sum(w)} | {f"w_{i}": F.sum(w * c(x)) for i, x in enumerate(names)}, descending=True)
    means = t.select("time", *[((c(f"w_{i}") + c(f"w_{i}_before")) / (c("w") + c("w_before"))).alias(f"m_{i}") for i in range(len(names))])
    died = own.where("event = 1").join(means, "time")
    died = died.join(average_ranks(died.select("time"), "time").select("time", "rank"), "time")
    out = died.select("rank", *[(c(x) - c(f"m_{i}")).alias(x) for i, x in enumerate(names)]).unpivot(["rank"], names, "covariate", "residual")
    rows = out.groupBy("covariate").agg(F.corr("residual", "rank").alias("r"), F.count("*").alias("n")).where("n > 2").collect()
    free(own)
    if not rows:
        return None
    p = lambda r, n: None if r is None or abs(r) >= 1 else float(t_two_sided(r * np.sqrt((n - 2) / (1 - r * r)), n - 2))
    return df.sparkSession.createDataFrame([(x["covariate"], x["r"], x["n"], p(x["r"], x["n"])) for x in rows], "covariate string, r double, n long, p_value double")


def cox_by_group(df: DataFrame, group: str, covariates: list[str] = [], reference=None, penalty: float = 0.0, with_concordance: bool = True) -> dict:  # noqa: B006
    """Cox regression with a 0/1 column for each group but the reference, and covariates."""
    held = save(df.select("time", "event", group, *[x for x in covariates if x != group]), "groups")
    wide, names = dummies(held, group, reference)
    found = cox(wide, [*names, *covariates], penalty, with_concordance=with_concordance)
    free(held)
    return found


def dummies(df: DataFrame, column: str, reference=None) -> tuple[DataFrame, list[str]]:
    """Add a 0/1 column for each value but the reference (the least one by default)."""
    values = [r[0] for r in df.where(c(column).isNotNull()).select(column).distinct().orderBy(column).collect()]  # groups are few
    reference = values[0] if reference is None and values else reference
    names = {v: f"{column}_{v}" for v in values if v != reference}
    return df.withColumns({n: (c(column) == lit(v)).cast("int") for v, n in names.items()}), list(names.values())
