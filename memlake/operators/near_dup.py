"""Greedy removal of near-duplicates within a source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Distance below which a row is a duplicate of a kept one, and the shortest text that stays.
DISTANCE, SHORTEST = 0.15, 20


def greedy(rows: DataFrame, distance: float = DISTANCE, shortest: int = SHORTEST) -> DataFrame:
    """(source_file, id, kept): longest first, a row goes if it is near any row kept before or too short.

    Whether a row stays depends on the rows before it, so each source is one group: one file's chunks, whose vectors a
    task holds once. Rows are compared with all kept ones by one product each.
    """

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(size=group.document.str.len()).sort_values(["size", "id"], ascending=[False, True])
        vectors = [np.asarray(v, dtype=float) for v in group.embedding]
        kept, n_kept, flags = np.zeros((16, max(map(len, vectors), default=0))), 0, []
        for size, v in zip(group["size"], vectors):
            n = np.linalg.norm(v)
            u = v / n if n else v
            good = size >= shortest and not (n_kept and n and (1 - kept[:n_kept] @ u).min() < distance)
            if good and n:
                if n_kept == len(kept):
                    kept = np.concatenate([kept, np.zeros_like(kept)])
                kept[n_kept] = u
                n_kept += 1
            flags.append(bool(good))
        return pd.DataFrame({"source_file": group.source_file, "id": group.id, "kept": flags})

    return rows.select("source_file", "id", "document", "embedding").groupBy("source_file").applyInPandas(chosen, "source_file string, id long, kept boolean")
