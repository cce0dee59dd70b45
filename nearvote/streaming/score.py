"""Stateless streaming scores: each micro-batch of request bodies is parsed, searched and answered like a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..functions import features as X
from ..functions import parse as P
from ..functions import rules as R
from ..operators import ivf, search


def score_bodies(bodies: DataFrame, index: ivf.Index, params: S.SearchParams) -> DataFrame:
    """(qid, body) to (qid, votes, approved, fraud_score, response)."""
    parsed = ivf.cut(P.parse(bodies).select("qid", "ok", *P.request_vector()), "parsed")  # keeps generated code small
    rows = parsed.select("*", *[F.when(F.col("ok"), X.quantize(F.col(v))).alias(q) for v, q in zip(S.V, S.Q)])
    return search.score(rows, index, params).select("*", R.response_json(F.col("votes")).alias("response"))


def score_stream(bodies: DataFrame, index: ivf.Index, out: str, checkpoint: str, params: S.SearchParams = S.SERVER_DEFAULTS, **trigger) -> StreamingQuery:
    """Writes each batch's answers under its number, so a batch that is run again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        score_bodies(batch, index, params).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return bodies.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
