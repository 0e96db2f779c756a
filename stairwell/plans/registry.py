"""All registered queries and their checks."""

from __future__ import annotations

from stairwell.plans import answers, curricula, labels, spans, tables

_MODULES = (tables, spans, answers, labels, curricula)

# Columns that are 32-bit in the queries; SQL list positions and row numbers are 64-bit.
_INTEGERS = {
    "squad_flatten": "paragraph",
    "conll_sentences": "sentence",
    "doc_stride_windows": "window first_token length",
    "head_features": "window",
    "answer_spans": "window start_position end_position",
    "answer_mask": "window cls_index start_position end_position",
    "batch_pad": "padded_length length pads",
    "nbest_spans": "window rank start_index end_index",
    "null_score": "window",
    "nbest_topk": "rank",
    "nbest_topk_spans": "rank",
    "nbest_softmax": "rank",
    "beam_nbest": "rank",
    "align_tags": "line",
    "mask_labels": "line length",
    "norm_linear": "dim",
    "norm_softmax": "dim",
    "norm_logsoftmax": "dim",
    "density_matrix": "i j",
    "vector_std": "dim",
    "cumulative_stages": "stage",
    "random_cumulative": "stage",
    "training_plan": "plan_pos",
    "stage_summary": "stage",
}


def all_queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def _typed(name: str, sql: str) -> str:
    columns = _INTEGERS.get(name, "").split()
    if not columns:
        return sql
    casts = ", ".join(f'CAST("{c}" AS INTEGER) AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql}) AS q"


def all_oracles() -> dict[str, str]:
    return {name: _typed(name, sql) for m in _MODULES for name, sql in m.ORACLE.items()}
