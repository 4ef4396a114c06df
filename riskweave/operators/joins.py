"""Join helpers: broadcast only behind a measured size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def sized_broadcast(small: DataFrame, max_rows: int) -> DataFrame:
    """Hint ``small`` for broadcast only when its measured row count is <= ``max_rows``.

    ``small`` is checkpointed first (reliable checkpoint dir) so the count and
    the join read one computation; nothing stays cached in executor memory
    (long-running streams call this every micro-batch) and the files are
    removed once the frame is no longer referenced. Above the bound the frame
    is returned unhinted: the join stays a shuffle join, which AQE may still
    turn into a broadcast after measuring the materialised side, or split when
    a key is skewed.
    """
    ensure_checkpoint_dir(small.sparkSession)
    small = small.checkpoint(eager=True)
    n = small.count()
    return F.broadcast(small) if n <= max_rows else small
