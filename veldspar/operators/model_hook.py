"""A hook for an external text model: chunks in, CSV text out, with retries and bisection.

The model itself is any callable from a prompt to text; calls are made within tasks, one
document at a time, and are the caller's to make idempotent.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from veldspar.operators.chunks import CONTEXT_CHARS, MAX_CHARS, ContextTooLarge, bisect_text, split

Model = Callable[[str], str]

#: What servers say when a prompt is too long, and with which status.
OVERFLOW_MARKS = ("context_length_exceeded", "maximum context length", "context window", "context too long", "too many tokens", "token limit exceeded", "上下文过大", "上下文超限")
OVERFLOW_STATUS = (400, 413, 422)
RETRIES = 2


class ModelError(Exception):
    """A failed call with the server's status (0: no answer) and text."""

    def __init__(self, status: int, body: str = "") -> None:
        super().__init__(f"{status} {body}")
        self.status, self.body = status, body

    @property
    def overflow(self) -> bool:
        return self.status in OVERFLOW_STATUS and any(m in self.body.lower() for m in OVERFLOW_MARKS)

    @property
    def passing(self) -> bool:
        """Whether another attempt may succeed."""
        return self.status in (0, 429) or self.status >= 500


def diagnose_empty(reasoning: str | None, finish: str | None, used: int | None, reasoned: int | None, limit: int) -> str:
    """Why an answer is empty: reasoning or output ate the token limit, or neither."""
    cut = finish in ("length", "max_tokens")
    spent = used is not None and used >= limit
    if (reasoning or "").strip() and (cut or spent or (reasoned is not None and reasoned >= limit)):
        return "reasoning_exhausted"
    return "output_exhausted" if cut or spent else "empty_response"


def call(model: Model, prompt: str, delays: tuple[float, ...] = (0.25, 0.5)) -> str:
    """An answer, after at most RETRIES more attempts if failures may pass."""
    for attempt in range(RETRIES + 1):
        try:
            return model(prompt).strip()
        except ModelError as error:
            if not error.passing or attempt == RETRIES:
                raise
            time.sleep(delays[attempt])
    raise AssertionError


def answers(model: Model, text: str, prompt: Callable[[str, str | None], str], max_chars: int = MAX_CHARS, context_chars: int = CONTEXT_CHARS) -> list[str]:
    """One answer for each chunk of a text; a chunk that is too long for the model is cut in two and its halves come next."""
    queue = deque(split(text, max_chars))
    out: list[str] = []
    prior: str | None = None
    while queue:
        chunk = queue.popleft()
        try:
            out.append(call(model, prompt(chunk, prior)))
        except ModelError as error:
            if not error.overflow:
                raise
            try:
                left, right = bisect_text(chunk)
            except ContextTooLarge:
                raise error from None
            queue.extendleft((right, left))
            continue
        prior = chunk[-context_chars:] if context_chars > 0 else None
    return out


def extract(docs: DataFrame, model: Model, prompt: Callable[[str, str | None], str]) -> DataFrame:
    """doc_id, batch_ord, csv and error for the answers of each document; a document whose calls fail has one row with the error."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                try:
                    got, error = answers(model, text or "", prompt), None
                except ModelError as failed:
                    got, error = [None], str(failed)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, len(got)), pa.array(range(len(got)), pa.int32()), pa.array(got, pa.string()), pa.array([error] * len(got), pa.string())], ["doc_id", "batch_ord", "csv", "error"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(asked, f"doc_id {kind}, batch_ord int, csv string, error string")
