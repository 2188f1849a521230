"""Column rules shared by scoring, calibration and evaluation."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LabelMeta:
    """Label sets the rules need: declined label, labels that may stand in for it, sensitive ones."""

    unknown: object
    safe_unknown: tuple
    sensitive: tuple


def is_correct(gold: Column, pred: Column, meta: LabelMeta) -> Column:
    return (pred == gold) | ((gold == F.lit(meta.unknown)) & pred.isin(*meta.safe_unknown))


def is_sensitive(pred: Column, meta: LabelMeta) -> Column:
    return pred.isin(*meta.sensitive)


def needed_conf(sensitive: Column, tau, tau_s) -> Column:
    tau = tau if isinstance(tau, Column) else F.lit(float(tau))
    tau_s = tau_s if isinstance(tau_s, Column) else F.lit(float(tau_s))
    return F.when(sensitive, F.greatest(tau, tau_s)).otherwise(tau)


def accept(conf: Column, sensitive: Column, tau, tau_s) -> Column:
    return conf >= needed_conf(sensitive, tau, tau_s)


def ratio(num: Column, den: Column, empty=0.0) -> Column:
    """num/den, with a stated value where the denominator is zero."""
    return F.when(den > 0, num / den).otherwise(F.lit(empty))


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def count_if(flag: Column) -> Column:
    return F.count_if(F.coalesce(flag, F.lit(False)))


def grid_column(rows: list[dict]) -> Column:
    """A literal array of structs, one per grid point; explode it to try every point."""
    return F.array(
        *[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows]
    )


def to_bands(score: Column, hi, lo) -> Column:
    return F.when(score >= hi, "high").when(score < lo, "low").otherwise("mid")
