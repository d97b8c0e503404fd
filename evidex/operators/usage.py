"""Model usage, cost, forecast, cap and routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import rules as R
from evidex.functions import text as T
from evidex.operators.scale import running

TOKENS = ("prompt", "completion", "cache_read", "cache_write")


def usage_rollup(calls: DataFrame) -> DataFrame:
    """usage(provider, model, requests, tokens..., retries) at both levels and in total."""
    sums = [F.sum(c).alias(c) for c in TOKENS]
    out = calls.rollup("provider", "model").agg(
        F.count(F.lit(1)).alias("requests"), *sums, F.sum("retries").alias("retries"),
        F.grouping_id().alias("level"))
    return out.withColumn("level", F.col("level").cast("bigint"))


def model_key(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``key``: vendor prefix cut, and a trailing snapshot number if the rest is priced."""
    vendors = "|".join(R.VENDOR_PREFIXES)
    bare = F.regexp_replace(F.regexp_replace(T.strip("model"), f"^({vendors})/", ""), rf"^({vendors})\.", "")
    base = F.regexp_replace("_m", r"-\d+$", "")
    known = prices.select("model").distinct()
    one = known.select(F.col("model").alias("_m"), F.lit(True).alias("_k1"))
    two = known.select(F.col("model").alias("_b"), F.lit(True).alias("_k2"))
    u = usage.withColumn("_m", bare).withColumn("_b", base)
    j = u.join(one, "_m", "left").join(two, "_b", "left")
    key = F.when(F.col("_k1").isNull() & F.col("_k2").isNotNull(), F.col("_b")).otherwise(F.col("_m"))
    return j.withColumn("key", key).select(*usage.columns, "key")


def dollars(rate_in: Column, rate_out: Column) -> Column:
    """USD of one usage row, in exact decimals, from USD per million tokens."""
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,0)")
    p, q = rate_in.cast("decimal(10,4)"), rate_out.cast("decimal(10,4)")
    mul = lambda s: F.lit(s).cast("decimal(4,2)")
    total = d("prompt") * p + d("completion") * q + d("cache_read") * p * mul(R.CACHE_READ_RATE) + d(
        "cache_write") * p * mul(R.CACHE_WRITE_RATE)
    return total.cast("decimal(36,6)") / F.lit(1_000_000).cast("decimal(7,0)")


def cost_by_model(usage: DataFrame, prices: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(model, key, requests, usd): overrides beat the list; unpriced models give null.

    ``prices(model, input, output)`` and ``overrides`` of the same shape.
    """
    u = model_key(usage, prices)
    p = prices.select(F.col("model").alias("key"), F.col("input").alias("_i"), F.col("output").alias("_o"))
    u = u.join(p, "key", "left")
    if overrides is not None:
        by_key = overrides.select(F.col("model").alias("key"), F.col("input").alias("_i1"), F.col("output").alias("_o1"))
        by_name = overrides.select("model", F.col("input").alias("_i2"), F.col("output").alias("_o2"))
        u = u.join(by_key, "key", "left").join(by_name, "model", "left")
        u = u.withColumn("_i", F.coalesce("_i1", "_i2", "_i")).withColumn("_o", F.coalesce("_o1", "_o2", "_o"))
    usd = dollars(F.col("_i"), F.col("_o"))
    return u.select("model", "key", "requests", F.col("prompt").alias("input_tokens"),
                    F.col("completion").alias("output_tokens"), usd.alias("usd_exact"),
                    F.bround(usd, 6).cast("double").alias("usd"))


def cost_report(costs: DataFrame) -> DataFrame:
    """One row: total as a floor, priced, and how many models lack a price."""
    free = F.col("key").isin(*R.FREE_MODELS) | F.col("model").isin(*R.FREE_MODELS)
    unpriced = F.col("usd").isNull() & ~free
    return costs.agg(
        F.bround(F.sum(F.coalesce("usd_exact", F.lit(0).cast("decimal(1,0)"))), 6).cast("double").alias("total_usd"),
        (F.count_if(unpriced) == 0).alias("priced"), F.count_if(unpriced).alias("n_unpriced"))


def forecast_sizes(classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group of classes(n_chars, layer, done): counts the forecast needs."""
    return classes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("all_classes"), F.sum("n_chars").alias("chars"),
        F.count_if(~F.col("done")).alias("n_classes"),
        F.count_if(~F.col("layer").isin(*R.MECHANICAL_LAYERS)).alias("involved_all"))


def _usd(tin: Column, tout: Column, rate: tuple[float, float]) -> Column:
    return (tin * F.lit(float(rate[0])) + tout * F.lit(float(rate[1]))) / F.lit(1e6)


def forecast_stages(sizes: DataFrame, keys: Sequence[str], rates: Mapping[str, tuple[float, float]],
                    critic: bool = True, targets: Column | None = None) -> DataFrame:
    """stages(keys, stage, calls, tokens_in, tokens_out_low, tokens_out_high, usd_low, usd_high).

    ``rates`` gives USD per million (input, output) tokens for the tiers cheap and frontier;
    ``targets`` the number of targets per group. Truncation follows integer casts.
    """
    n, t = F.col("n_classes"), targets if targets is not None else F.col("n_targets")
    domains = F.when(t > 0, F.greatest(F.lit(1), F.bround(t / 2, 0).cast("bigint"))).otherwise(0)
    avg = F.floor(F.col("chars") / F.greatest(F.lit(1), F.col("all_classes")))
    big = (avg * R.TARGET_GROWTH).cast("bigint")
    o = R.OVERHEAD
    plan = [("comprehend", "cheap", n, avg + o["comprehend"]), ("plan", "cheap", domains, avg + o["plan"]),
            ("generate", "frontier", t, big + o["generate"])]
    if critic:
        plan.append(("critic", "frontier", t, big + o["critic"]))
    rows = []
    for i, (stage, tier, calls, chars) in enumerate(plan):
        calls = calls.cast("bigint")
        tin = (calls * chars / R.CHARS_PER_TOKEN).cast("bigint")
        low = (calls * R.OUTPUT_CAPS[stage] * F.lit(R.OUT_LOW)).cast("bigint")
        high = (calls * R.OUTPUT_CAPS[stage] * F.lit(R.OUT_HIGH)).cast("bigint")
        rows.append(F.when(calls > 0, F.struct(
            F.lit(i).alias("ord"), F.lit(stage).alias("stage"), F.lit(tier).alias("tier"), calls.alias("calls"),
            tin.alias("tokens_in"), low.alias("tokens_out_low"), high.alias("tokens_out_high"),
            _usd(tin, low, rates[tier]).alias("usd_low"), _usd(tin, high, rates[tier]).alias("usd_high"),
            (calls * R.SECONDS[tier][0]).alias("s_low"), (calls * R.SECONDS[tier][1]).alias("s_high"))))
    return sizes.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("s")).select(*keys, "s.*")


def forecast_totals(sizes: DataFrame, stages: DataFrame, keys: Sequence[str], rates: Mapping[str, tuple[float, float]],
                    concurrency: int = 8, cap: float = 0.0, targets: Column | None = None) -> DataFrame:
    """Totals per group with the repair band, time under concurrency, review hours and the budget verdict."""
    t = targets if targets is not None else F.col("n_targets")
    sums = stages.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("calls", "tokens_in", "usd_low", "usd_high", "s_low", "s_high")])
    j = sizes.join(sums, list(keys), "left")
    avg = F.floor(F.col("chars") / F.greatest(F.lit(1), F.col("all_classes")))
    big = (avg * R.TARGET_GROWTH).cast("bigint")
    lo, hi = (t * F.lit(R.REPAIR_LOW)).cast("bigint"), (t * F.lit(R.REPAIR_HIGH)).cast("bigint")
    tin = (hi * (big + R.OVERHEAD["generate"]) / R.CHARS_PER_TOKEN).cast("bigint")
    tin_lo = (tin * lo / F.greatest(F.lit(1), hi)).cast("bigint")
    cap_out, rate = R.OUTPUT_CAPS["generate"], rates["frontier"]
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    usd_lo = z("usd_low") + _usd(tin_lo, (lo * cap_out * F.lit(R.OUT_LOW)).cast("bigint"), rate)
    usd_hi = z("usd_high") + _usd(tin, (hi * cap_out * F.lit(R.OUT_HIGH)).cast("bigint"), rate)
    secs_hi = z("s_high") + hi * R.SECONDS["frontier"][1]
    share = F.col("n_classes") / F.col("all_classes")
    involved = F.bround(F.col("involved_all") * share, 0)
    routine = F.greatest(F.lit(0.0), F.bround(F.col("all_classes") * share, 0) - involved)
    a, b = R.REVIEW_MINUTES["routine"], R.REVIEW_MINUTES["involved"]
    low, high = F.bround(usd_lo, 2), F.bround(usd_hi, 2)
    c = F.lit(float(cap))
    verdict = (F.lit(None).cast("string") if cap <= 0 else
               F.when(high > c, F.when(low <= c, "may exceed, high estimate exceeds").otherwise("will exceed")).otherwise("within"))
    return j.select(
        *keys, F.coalesce("calls", F.lit(0)).cast("bigint").alias("calls"), F.coalesce("tokens_in", F.lit(0)).cast("bigint").alias("tokens_in"),
        low.alias("cost_low"), high.alias("cost_high"),
        F.bround(z("s_low") / concurrency / 60, 1).alias("minutes_low"), F.bround(secs_hi / concurrency / 60, 1).alias("minutes_high"),
        F.bround((routine * a[0] + involved * b[0]) / 60, 1).alias("review_low"),
        F.bround((routine * a[1] + involved * b[1]) / 60, 1).alias("review_high"),
        (F.lit(None).cast("boolean") if cap <= 0 else (high > c)).alias("will_exceed"),
        (F.lit(None).cast("boolean") if cap <= 0 else ((low <= c) & (c < high))).alias("may_exceed"), verdict.alias("budget"))


def cap_cutoff(calls: DataFrame, cap: float, run: str = "run", seq: str = "seq", usd: str = "usd") -> DataFrame:
    """Add spent_before and admitted: a call runs while the spend before it is under the cap.

    One run may hold any share of the calls. Unpriced calls add nothing.
    """
    amount = F.col(usd).cast("decimal(18,6)")
    out = running(calls, [run], [F.col(seq)], seq="_n", value=amount, before="spent_before").drop("_n")
    return out.withColumn("admitted", F.col("spent_before") < F.lit(str(cap)).cast("decimal(18,6)"))


def call_replay_summary(calls: DataFrame) -> DataFrame:
    """By stage family: calls, cached, sorted distinct models (few), prompt characters."""
    return calls.groupBy(F.substring_index("stage", "_", 1).alias("stage")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("cached").alias("cached"),
        F.array_sort(F.collect_set("model")).alias("models"), F.sum("prompt_chars").alias("chars")).orderBy(
        F.desc("calls"), "stage")


def replay_totals(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count(F.lit(1)).alias("total"), F.count_if("cached").alias("cached"),
                     F.count_if(~F.col("cached")).alias("live"), F.countDistinct("model").alias("models"))


def content_key(stage: Column, provider: Column, model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("|", stage, F.concat_ws(":", provider, model), prompt), 256)


def content_key_cache(calls: DataFrame) -> DataFrame:
    """calls(seq, key) with ``cached``: the key was seen at an earlier seq.

    The first seq per key is a map-side minimum; copies of one prompt are never gathered.
    """
    first = calls.groupBy("key").agg(F.min("seq").alias("_first"))
    return calls.join(first, "key").select(*calls.columns, (F.col("seq") > F.col("_first")).alias("cached"))


def route_tier(stages: DataFrame, models: Mapping[str, str], default: str, enabled: bool = True,
               tiers: Mapping[str, str] | None = None) -> DataFrame:
    """Add family, tier and model; a disabled router or a missing tier gives the default model."""
    s = F.col("stage")
    family = None
    for f in R.STAGE_TIERS:
        family = F.when(s.startswith(f), f) if family is None else family.when(s.startswith(f), f)
    family = family.otherwise("generate")
    chosen = {**R.STAGE_TIERS, **(tiers or {})}
    tier = None
    for f, x in chosen.items():
        tier = F.when(F.col("family") == f, x) if tier is None else tier.when(F.col("family") == f, x)
    model = F.lit(None).cast("string")
    for x, m in models.items():
        model = F.when(F.col("tier") == x, m).otherwise(model)
    out = stages.withColumn("family", family).withColumn("tier", tier.otherwise("frontier"))
    return out.withColumn("model", F.coalesce(model, F.lit(default)) if enabled else F.lit(default))
