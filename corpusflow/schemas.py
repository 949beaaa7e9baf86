"""Declared schemas of stored tables; readers use these and never infer."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TARGETS = _table(id=_S, law_name=_S, title=_S, language=_S, url=_S)
SNAPSHOTS = _table(id=_S, url=_S, content=_S, content_hash=_S, bytes=_L, fetched_at=_TS)
MANIFEST = _table(id=_S, law_name=_S, title=_S, url=_S, content_hash=_S, fetched_at=_TS, bytes=_L)
CHANGE_LOG = _table(as_of=_TS, id=_S, status=_S, old_hash=_S, new_hash=_S)
ARTICLES = _table(id=_S, law_name=_S, ord=_I, article_number=_S, article_title=_S, chapter=_S,
                  section_title=_S, text=_S)
CHUNKS = _table(id=_S, chunk_key=_S, text=_S, law_name=_S, article_number=_S, chapter=_S, section_title=_S,
                source_id=_S, token_estimate=_I, part_index=_I, part_count=_I)
VECTORS = _table(id=_S, text=_S, law_name=_S, article_number=_S, chapter=_S, section_title=_S,
                 embedding_vector=T.ArrayType(T.FloatType()))
REFERENCES = T.ArrayType(_table(id=_S, code=_S, article=_S, title=_S, excerpt=_S, score=T.DoubleType()))
MESSAGES = _table(id=_S, session_id=_S, role=_S, content=_S, created_at=_TS, references_json=_S)
SESSIONS = _table(id=_S, title=_S, created_at=_TS, updated_at=_TS)
MODEL_OUTPUTS = _table(doc_id=_S, chunk_idx=_I, raw=_S)
TOKEN_EVENTS = _table(session_id=_S, seq=_L, token=_S, stop_reason=_S, ts=_TS)
