"""Decision rules, and replays of logged decisions under other rules.

A replay tries a short list of rules on every row: the rules are exploded from a literal
array and aggregated at once, so a task sends one row per rule.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import LabelMeta, count_if, grid_column, is_correct, is_sensitive, needed_conf, ratio, share


def _outcome_stats(rows: DataFrame, by: list[str], meta: LabelMeta, rescued: Column | None = None, *more: Column) -> DataFrame:
    """Accuracy, accepted rows, accuracy among them and sensitive false exposures of `final`, and further aggregates."""
    ok = is_correct(F.col("label"), F.col("final"), meta)
    acc = F.col("final") != F.lit(meta.unknown)
    fe = is_sensitive(F.col("final"), meta) & (F.col("final") != F.col("label"))
    cols = [F.count("*").alias("n"), share(ok).alias("primary"), count_if(acc).alias("accepted"),
            ratio(count_if(acc & ok), count_if(acc)).alias("acc_sel"), count_if(fe).alias("sens_fe")]
    if rescued is not None:
        cols += [count_if(rescued).alias("rescued"), ratio(count_if(rescued & ok), count_if(rescued), 1.0).alias("resc_prec")]
    return rows.groupBy(*by).agg(*cols, *more)


def replay_cascade(df: DataFrame, rules: list[dict], tau: float, tau_s: float, meta: LabelMeta) -> DataFrame:
    """First layer if confident, else the head if sure enough, else a rescue rule (never for
    a sensitive label), else unknown. A rule has kind none, agree or l2 and limits a, s, g."""
    r = df.withColumn("rule", F.explode(grid_column(rules)))
    head = F.col("head_p") >= needed_conf(is_sensitive(F.col("head_label"), meta), tau, tau_s)
    far = (F.col("l2_score") >= F.col("rule.s")) & (F.col("l2_gap") >= F.col("rule.g"))
    agree = (F.col("rule.kind") == "agree") & (F.col("head_label") == F.col("l2_label")) & (F.col("head_p") >= F.col("rule.a")) & far
    l2 = (F.col("rule.kind") == "l2") & far
    rescue = ~F.col("l2_confident") & ~head & ~is_sensitive(F.col("l2_label"), meta) & (agree | l2)
    final = (F.when(F.col("l2_confident"), F.col("l2_label")).when(head, F.col("head_label"))
             .when(rescue, F.col("l2_label")).otherwise(F.lit(meta.unknown)))
    rows = r.select("label", F.col("rule.name").alias("rule"), final.alias("final"), rescue.alias("rescued"))
    return _outcome_stats(rows, ["rule"], meta, F.col("rescued"))


def choose_rescue(stats: DataFrame, base: str, prec: float = 0.976, slack: float = 0.002) -> DataFrame:
    """The rule of greatest accuracy among those precise enough that do not cost accepted accuracy."""
    floor = stats.filter(F.col("rule") == base).agg(F.first("acc_sel")).scalar()
    good = stats.withColumn("_floor", floor).filter(
        (F.col("rule") != base) & (F.col("resc_prec") >= prec) & (F.col("acc_sel") >= F.col("_floor") - slack))
    return good.drop("_floor").orderBy(F.desc(F.round("primary", 6)), F.desc("rule")).limit(1)


def replay_veto_override(df: DataFrame, grid: list[dict], tau_s: float, meta: LabelMeta, secondary: str | None = None) -> DataFrame:
    """Layer-3 answers that are not degraded are held to another threshold; a degraded
    layer-2 answer the head contradicts is vetoed to unknown; a layer-2 answer a very sure
    head contradicts is replaced by the head's. With `secondary`, not when the head names it."""
    r = df.withColumn("g", F.explode(grid_column(grid)))
    known = F.col("pred") != F.lit(meta.unknown)
    ts = F.greatest(F.lit(tau_s), F.col("g.tau"))
    low = F.col("conf") < F.when(is_sensitive(F.col("pred"), meta), ts).otherwise(F.col("g.tau"))
    contra = F.col("head_label") != F.col("pred")
    third = (F.col("layer") == 3) & ~F.col("degraded") & known & low
    veto = (F.col("layer") == 2) & known & F.col("degraded") & (F.col("g.veto") == 1) & contra
    need = F.greatest(F.col("g.ovr"), F.when(is_sensitive(F.col("head_label"), meta), ts).otherwise(F.lit(0.0)))
    over = ((F.col("layer") == 2) & known & ~F.col("degraded") & (F.col("g.ovr") > 0) & contra
            & (F.col("head_label") != F.lit(meta.unknown)) & (F.col("head_p") >= need))
    if secondary:
        over = over & (F.col("head_label") != F.col(secondary))
    final = F.when(third | veto, F.lit(meta.unknown)).when(over, F.col("head_label")).otherwise(F.col("pred"))
    rows = r.select("label", F.col("g.tau").alias("tau"), F.col("g.veto").alias("veto"), F.col("g.ovr").alias("ovr"),
                    final.alias("final"), over.alias("over"))
    return _outcome_stats(rows, ["tau", "veto", "ovr"], meta, None, F.count_if("over").alias("overrides"))


def replay_tau(df: DataFrame, taus: list[float], tau_s: float, meta: LabelMeta) -> DataFrame:
    """Layer-3 outputs held to other thresholds; everything else stands."""
    r = df.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    ts = F.greatest(F.lit(tau_s), F.col("tau"))
    low = F.col("conf") < F.when(is_sensitive(F.col("pred"), meta), ts).otherwise(F.col("tau"))
    final = F.when((F.col("layer") == 3) & ~F.col("degraded") & low, F.lit(meta.unknown)).otherwise(F.col("pred"))
    return _outcome_stats(r.select("label", "tau", final.alias("final")), ["tau"], meta)


def replay_head_path(df: DataFrame, prefixes: list[str], tau: float, tau_s: float, meta: LabelMeta) -> DataFrame:
    """Only rows whose reason starts with a given prefix are decided again, from the head's first choice."""
    path = F.lit(False)
    for p in prefixes:
        path = path | F.col("reason").startswith(p)
    sure = F.col("head_p") >= needed_conf(is_sensitive(F.col("head_label"), meta), tau, tau_s)
    final = F.when(~path, F.col("pred")).when(sure, F.col("head_label")).otherwise(F.lit(meta.unknown))
    return df.withColumn("final", final)


def topic_vote(df: DataFrame, cs=0.45, cn=0.25, bs=1.0, bn=0.3, min_words=4, min_turns=3) -> DataFrame:
    """Adds `vote` (same or new) and `escalate` from the signals words, user_turns, bm25, cos."""
    guard = (F.col("words") < min_words) | (F.col("user_turns") < min_turns)
    b = F.when(F.col("bm25") >= bs, "same").when(F.col("bm25") <= bn, "new").otherwise("unsure")
    c = F.when(F.col("cos") >= cs, "same").when(F.col("cos") <= cn, "new").otherwise("unsure")
    any_same = (b == "same") | (c == "same")
    both_new = (b == "new") & (c == "new")
    one_new = (b == "new") | (c == "new")
    vote = F.when(guard | any_same, "same").when(both_new, "new").otherwise("same")
    return df.withColumn("vote", vote).withColumn("escalate", ~guard & ~any_same & ~both_new & one_new)


def topic_metrics(df: DataFrame, by=()) -> DataFrame:
    new, same = F.col("gold") == "new", F.col("gold") == "same"
    said_new = F.col("vote") == "new"
    recall = ratio(count_if(new & said_new), count_if(new))
    false = ratio(count_if(same & said_new), count_if(same))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), share(F.col("gold") == F.col("vote")).alias("acc"), recall.alias("switch_recall"),
        false.alias("false_switch"), ((recall + 1 - false) / 2).alias("bal"), share(F.col("escalate")).alias("escalation"))


def topic_threshold_grid(df: DataFrame, cns: list[float], css: list[float], max_false: float = 0.05, bs=1.0, bn=0.3,
                         min_words=4, min_turns=3) -> DataFrame:
    """The cosine pair (cn < cs) of greatest balanced accuracy with few false switches.

    A vote is `new` only when both signals say new, so per row only the number of thresholds
    its cosine passes matters; rows are counted by that before the grid is tried."""
    cns, css = sorted(cns), sorted(css)
    guard = (F.col("words") < min_words) | (F.col("user_turns") < min_turns)
    may = ~guard & (F.col("bm25") < bs) & (F.col("bm25") <= bn)
    at_or_below = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cns]), lambda c: F.col("cos") <= c))
    at_or_above = F.size(F.filter(F.array(*[F.lit(float(c)) for c in css]), lambda c: F.col("cos") >= c))
    counts = df.groupBy("gold", may.alias("may"), at_or_below.alias("dn"), at_or_above.alias("up")).agg(F.count("*").alias("n"))
    low = grid_column([{"v": float(a), "need": len(cns) - i} for i, a in enumerate(cns)])
    high = grid_column([{"v": float(b), "need": j + 1} for j, b in enumerate(css)])
    x = counts.withColumn("a", F.explode(low)).withColumn("b", F.explode(high)).filter(F.col("a.v") < F.col("b.v"))
    new = F.col("may") & (F.col("dn") >= F.col("a.need")) & (F.col("up") < F.col("b.need"))

    def total(cond):
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    is_new = F.col("gold") == "new"
    recall = ratio(total(is_new & new), total(is_new))
    false = ratio(total(~is_new & new), total(~is_new))
    per = x.groupBy(F.col("a.v").alias("cn"), F.col("b.v").alias("cs")).agg(
        recall.alias("switch_recall"), false.alias("false_switch"), ((recall + 1 - false) / 2).alias("bal"))
    return per.filter(F.col("false_switch") <= max_false).orderBy(F.desc(F.round("bal", 12)), "cn", "cs").limit(1)


def knn_rescue_replay(df: DataFrame, rules: list[dict], tau: float, tau_s: float, meta: LabelMeta) -> DataFrame:
    """As the cascade, rescued by the nearest pool exemplar (nn_sim, nn_label) from c up,
    optionally only when the head agrees. A rule with a null c rescues nothing."""
    r = df.withColumn("rule", F.explode(grid_column(rules)))
    head = F.col("head_p") >= needed_conf(is_sensitive(F.col("head_label"), meta), tau, tau_s)
    rescue = (~F.col("l2_confident") & ~head & F.coalesce(F.col("nn_sim") >= F.col("rule.c"), F.lit(False))
              & ~is_sensitive(F.col("nn_label"), meta)
              & ((F.col("rule.agree") == 0) | (F.col("head_label") == F.col("nn_label"))))
    final = (F.when(F.col("l2_confident"), F.col("l2_label")).when(head, F.col("head_label"))
             .when(rescue, F.col("nn_label")).otherwise(F.lit(meta.unknown)))
    rows = r.select("label", F.col("rule.c").alias("c"), F.col("rule.agree").alias("agree"), final.alias("final"), rescue.alias("rescued"))
    return _outcome_stats(rows, ["c", "agree"], meta, F.col("rescued"))


def choose_knn_rule(stats: DataFrame, prec: float = 0.976, slack: float = 0.002) -> DataFrame:
    """The rule of greatest accuracy (ties: greatest c, then the one that needs agreement) among those precise enough
    whose accuracy over accepted rows falls by `slack` at most; the base, the row with a null c, if none is."""
    sel = F.when(F.col("accepted") > 0, F.col("primary") * F.col("n") / F.col("accepted")).otherwise(0.0)
    s = stats.withColumn("_sel", sel)
    floor = s.filter("c IS NULL").agg(F.first("_sel")).scalar()
    good = F.col("c").isNull() | ((F.col("resc_prec") >= prec) & (F.col("_sel") >= F.col("_floor") - slack))
    return s.withColumn("_floor", floor).filter(good).orderBy(
        F.col("c").isNull(), F.desc(F.round("primary", 6)), F.desc("c"), F.desc("agree")).drop("_floor", "_sel").limit(1)


def fallback_fuse(df: DataFrame, probs: str, scores: str, tau: float, k: int = 5) -> DataFrame:
    """For rows under tau: among the head's top k labels, the choice by a second score and by
    log prior + second score. `probs` and `scores` are arrays over the labels."""
    low = df.filter(F.array_max(probs) < tau)
    entries = F.transform(F.col(probs), lambda p, i: F.struct(p.alias("p"), (-i).alias("neg"), F.get(F.col(scores), i).alias("s")))
    top = F.slice(F.sort_array(entries, asc=False), 1, k)
    rr = F.array_max(F.transform(top, lambda e: F.struct(e["s"].alias("v"), e["neg"].alias("neg"))))
    fuse = F.array_max(F.transform(top, lambda e: F.struct((F.log(e["p"] + 1e-9) + e["s"]).alias("v"), e["neg"].alias("neg"))))
    return low.withColumn("head", -top[0]["neg"]).withColumn("by_score", -rr["neg"]).withColumn("by_fusion", -fuse["neg"])
