"""Token counts by section, from offsets of one encoding of the whole document.

Tokens of a byte-level vocabulary joined are the text, so running sums of their widths
are their spans. Spans are matched with sections by one merge of the two sorted lists.
A token that crosses a boundary is allocated by an explicit rule:

* ``start``: to the section that holds its first character;
* ``end``: to the one that holds its last;
* ``most``: to the one that holds most of it, the earlier one if equal.

Every token goes to exactly one section, so a document's sections sum to its tokens.

Cases: a null or empty text has one section, without tokens. Very long texts are
encoded whole. Repeated rows count each. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumentide.llm.textio import blocks
from lumentide.llm.tokens import ByteTokenizer, held

RULES = ("start", "end", "most")


def line_sections(text: bytes) -> np.ndarray:
    """Byte offsets at which the lines begin; a line holds the newline that ends it."""
    return np.concatenate(([0], np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1))


def allocate(ends: np.ndarray, begins: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token. ``ends``: where tokens end; ``begins``: where sections begin, first 0."""
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.searchsorted(begins, starts, side="right") - 1
    if rule == "start":
        return first
    last = np.searchsorted(begins, ends - 1, side="right") - 1
    if rule == "end":
        return last
    out = first.copy()
    for i in np.flatnonzero(last > first):
        cuts = np.concatenate(([starts[i]], begins[first[i] + 1 : last[i] + 1], [ends[i]]))
        out[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return out


def attribute_tokens(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    rule: str = "start",
    sections: Callable[[bytes], np.ndarray] = line_sections,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each section: id, section (from 0), start_char, end_char, n_tokens, n_crossing, doc_tokens. One pass, no shuffle.

    n_crossing: the section's tokens that also reach into another one.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = held(ByteTokenizer, ranks_path, pattern)
        for part, texts in blocks(batches):
            rows, columns = [], [[] for _ in range(6)]
            for i, text in enumerate(texts):
                text = text or b""
                _, ends = tokenizer.encode_spans(text)
                begins = sections(text)
                own = allocate(ends, begins, rule)
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                crossing = np.searchsorted(begins, ends - 1, side="right") - 1 != np.searchsorted(begins, starts, side="right") - 1
                bounds = np.concatenate((begins, [len(text)]))
                if not text.isascii():
                    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                    bounds = chars[bounds]
                m = len(begins)
                values = (np.arange(m), bounds[:-1], bounds[1:], np.bincount(own, minlength=m), np.bincount(own[crossing], minlength=m), np.full(m, len(ends)))
                rows.append(np.full(m, i))
                for column, v in zip(columns, values, strict=True):
                    column.append(v)
            ids = part.column(0).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c).astype(np.int64)) for c in columns)], ["id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"])

    schema = f"id {kind}, section long, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long"
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, schema).withColumnRenamed("id", id_col)
