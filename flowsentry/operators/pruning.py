"""Joins that keep only what can matter.

Adaptive execution can turn a join into a broadcast join only after both sides have been shuffled,
and shuffling the packets is what pruning is to save. So a pruning table is computed first, and
marked for broadcast if it turned out small; a large one takes part in an ordinary shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.session import ensure_checkpoint_dir

# Rows of a few short columns; some tens of megabytes.
BROADCAST_ROWS = 500_000


def settle(df: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute a derived table once, and mark it for broadcast if its size allows."""
    ensure_checkpoint_dir(df.sparkSession)
    settled = df.checkpoint()
    return F.broadcast(settled) if settled.count() <= broadcast_rows else settled
