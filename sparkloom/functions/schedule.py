"""Learning-rate schedules, step counts and one optimiser step as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def warmup_cosine(step: Column, warmup: int, total: int) -> Column:
    """Linear over the warm-up, whose last step reaches 1, then half a cosine to 0."""
    progress = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, (step + 1) / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(math.pi) * F.least(F.lit(1.0), progress)))))


def one_cycle(step: Column, total: int, peak: float, pct_start: float = 0.3, div: float = 8.0, final_div: float = 100.0) -> Column:
    """Cosine from peak / div to peak, then to peak / div / final_div."""
    up = pct_start * total - 1
    down = total - 1 - up
    anneal = lambda a, b, pct: b + (a - b) / 2 * (1 + F.cos(F.lit(math.pi) * pct))
    return F.when(step <= up, anneal(peak / div, peak, step / up)).otherwise(anneal(peak, peak / div / final_div, (step - up) / down))


def optimiser_steps(micro_batches: int, accumulate: int, epochs: int, spare_per_epoch: int = 0, max_steps: int = 0) -> int:
    """Steps of all epochs; each has one at least. A positive max_steps is the number itself."""
    if max_steps > 0:
        return max_steps
    return (max(1, max(1, micro_batches) // max(1, accumulate)) + spare_per_epoch) * epochs


def step_counts(settings: DataFrame) -> DataFrame:
    """Adds total_steps to rows (n_rows, batch_size, accumulate, epochs, max_steps), as optimiser_steps counts them."""
    one = F.lit(1)
    micro = F.greatest(one, F.ceil(F.col("n_rows") / F.col("batch_size")))
    each = F.greatest(one, F.floor(micro / F.greatest(one, F.col("accumulate"))))
    return settings.withColumn("total_steps", F.when(F.col("max_steps") > 0, F.col("max_steps")).otherwise(each * F.col("epochs")).cast("bigint"))


def anchored_adamw(
    theta: Column, m: Column, v: Column, init: Column, g: Column, step: int, lr: float = 1e-3, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8, decay: float = 0.01
) -> dict[str, Column]:
    """theta, m and v after one step that decays towards the initial value, after the gradient part."""
    if lr < 0 or eps < 0 or decay < 0 or not all(0 <= b < 1 for b in betas):
        raise ValueError("lr, eps and decay must not be negative, betas must lie in [0, 1)")
    m1 = betas[0] * m + (1 - betas[0]) * g
    v1 = betas[1] * v + (1 - betas[1]) * g * g
    moved = theta - lr * (m1 / (1 - betas[0] ** step)) / (F.sqrt(v1 / (1 - betas[1] ** step)) + eps)
    return {"theta": moved - lr * decay * (moved - init), "m": m1, "v": v1}


def parse_ks(text: str) -> list[int]:
    """Cut-offs from a comma-separated option."""
    return sorted({int(x) for x in text.split(",") if x.strip()})
