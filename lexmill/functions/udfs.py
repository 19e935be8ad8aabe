"""SQL names for the kernels that take one utterance or recording as an array of arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import symbols
from lexmill.operators import clusters, kernels


def _matrix(rows) -> np.ndarray:
    return np.array([list(r) for r in rows], float) if rows is not None and len(rows) else np.zeros((0, 1))


def register(spark: SparkSession) -> None:
    """``ctc_greedy(logp)``, ``ctc_beam(logp)``, ``ctc_align(logp, targets)`` and ``agglomerate(vectors)`` [K1, K3, K4, K7].

    The blank is the last class of the vocabulary.
    """
    names, blank = dict(enumerate(symbols())), len(symbols())

    @F.pandas_udf("string")
    def ctc_greedy(logp: pd.Series) -> pd.Series:
        return logp.map(lambda x: kernels.greedy(_matrix(x), names, blank))

    @F.pandas_udf("string")
    def ctc_beam(logp: pd.Series) -> pd.Series:
        return logp.map(lambda x: kernels.beam_search(_matrix(x), names, blank, beta=0.5))

    @F.pandas_udf("array<struct<idx:int,token:int,start:int,end:int,score:double>>")
    def ctc_align(logp: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([[{"idx": s.index, "token": s.token, "start": s.start, "end": s.end, "score": s.score} for s in kernels.forced_align(_matrix(x), [int(i) for i in t], blank)] for x, t in zip(logp, targets)])

    @F.pandas_udf("array<int>")
    def agglomerate(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: clusters.agglomerate(_matrix(x)))

    for f in (ctc_greedy, ctc_beam, ctc_align, agglomerate):
        spark.udf.register(f.__name__, f)
