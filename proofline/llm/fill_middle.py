"""Fill-in-middle transformation of texts cut at line ends.

One scan of a batch of texts by a byte automaton, whose tables are built below
from byte classes: its states know how many UTF-8 continuation bytes are due,
whether the next character opens a unit (a line with its end), and how much of
a sentinel has been read. Each transition emits what it counts: the start of a
character, the start of a unit, the end of a sentinel. The automaton forgets all
but the last ``MEMORY`` bytes (checked when the tables are built), so the states
of a whole batch come from ``MEMORY`` + 1 table look-ups over arrays. A second pass
turns the two drawn unit numbers of a text into byte and character positions.

Defined results: a null text counts as empty and stays plain, as do texts that
hold a sentinel; a null doc_id draws as the empty string; repeated rows give
repeated results; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import small_batches, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHAR, UNIT, SENTINEL = 1, 2, 4
MEMORY = 4
#: Ends a text in a batch; the byte is never part of UTF-8.
_END = 0xFF
#: Bytes of a batch scanned at once, but for texts that are longer.
SCANNED = 4_000_000


def _tables() -> tuple[np.ndarray, np.ndarray, int]:
    """Next state and emission for each state and byte, and the first state."""
    letters = {ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)}
    states = [("unit", 0), ("line", 0), ("open", 0), ("letter", 0), ("line", 1), ("line", 2), ("line", 3)]
    number = {s: k for k, s in enumerate(states)}
    after, emits = np.zeros((len(states), 256), np.uint8), np.zeros((len(states), 256), np.uint8)
    for (kind, due), k in number.items():
        for byte in range(256):
            starts = CHAR | (UNIT if kind == "unit" else 0)
            if byte == _END:
                to, out = ("unit", 0), 0
            elif 0x80 <= byte < 0xC0:  # continuation
                to, out = ("line", max(0, due - 1)), 0
            elif byte >= 0xC0:
                to, out = ("line", 1 + (byte >= 0xE0) + (byte >= 0xF0)), starts
            elif byte == 0x0A:
                to, out = ("unit", 0), starts
            elif byte == ord("<"):
                to, out = ("open", 0), starts
            elif byte in letters and kind == "open":
                to, out = ("letter", 0), starts
            elif byte == ord(">") and kind == "letter":
                to, out = ("line", 0), starts | SENTINEL
            else:
                to, out = ("line", 0), starts
            after[k, byte], emits[k, byte] = number[to], out
    return after, emits, number["unit", 0]


_AFTER, _EMITS, _FIRST = _tables()


def _columns(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte (bytes that no state tells apart), and the table by class."""
    distinct, of = np.unique(table, axis=1, return_inverse=True)
    return of.ravel().astype(np.uint8), distinct


_CLASS, _PACKED = _columns(np.concatenate([_AFTER, _EMITS]))
_AFTER, _EMITS = _PACKED[: len(_AFTER)].copy(), _PACKED[len(_AFTER) :].copy()
_WIDTH = _AFTER.shape[1]


def _forgets(memory: int) -> bool:
    """Whether any ``memory`` classes lead all states that text can be in to one state."""
    held = {tuple(range(len(_AFTER)))}
    for _ in range(memory):
        held = {tuple(sorted(set(_AFTER[list(s), c].tolist()))) for s in held for c in range(_WIDTH)}
    return all(len(s) == 1 for s in held)


if not _forgets(MEMORY):
    raise AssertionError("the automaton needs more memory")


def scan(data: np.ndarray) -> np.ndarray:
    """What each byte's transition emits, for texts of which each ends by the byte 0xFF."""
    kinds = _CLASS[data]
    padded = np.concatenate((np.full(MEMORY + 1, _CLASS[_END], np.uint8), kinds))
    at = np.full(len(data), _FIRST, np.uint8)
    after, emits = _AFTER.ravel(), _EMITS.ravel()
    for k in range(1, MEMORY + 1):
        at = after[at * np.uint8(_WIDTH) + padded[k : k + len(data)]]
    return emits[at * np.uint8(_WIDTH) + kinds]


def _arranged(texts: list[bytes], draws: np.ndarray, plain_from: int, spm_below: int) -> pd.DataFrame:
    """n, form, prefix_chars, middle_chars and output of each text; draws holds h1 to h4 of each."""
    data = np.frombuffer(b"".join(x for t in texts for x in (t, b"\xff")), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # the end byte of each text
    starts = np.concatenate(([0], ends[:-1] + 1))
    emitted = scan(data)
    chars = np.concatenate(([0], np.cumsum(emitted & CHAR, dtype=np.int64)))
    opens = np.flatnonzero(emitted & UNIT)
    first, last = np.searchsorted(opens, starts), np.searchsorted(opens, ends)
    n = last - first
    closes = np.flatnonzero(emitted & SENTINEL)
    held = np.searchsorted(closes, ends) > np.searchsorted(closes, starts)
    h = draws.astype(np.int64)
    cuts = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
    # second pass: unit numbers to bytes, and bytes to characters
    at = np.where(cuts < n[:, None], np.append(opens, 0)[np.minimum(first[:, None] + cuts, len(opens))], ends[:, None])
    plain = held | (ends == starts) | (h[:, 2] % 100 >= plain_from)
    form = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm_below, "spm", "psm"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    out = []
    for text, kind, (a, b) in zip(texts, form, (at - starts[:, None]).tolist(), strict=True):
        before, middle, rest = text[:a], text[a:b], text[b:]
        arranged = text if kind == "plain" else b"".join((p, before, s, rest, m, middle) if kind == "psm" else (s, rest, p, before, m, middle))
        out.append(arranged.decode("utf-8"))
    count = lambda x: pd.array(np.where(plain, 0, x), dtype="Int64")
    prefix, middle = count(chars[at[:, 0]] - chars[starts]), count(chars[at[:, 1]] - chars[at[:, 0]])
    prefix[plain], middle[plain] = pd.NA, pd.NA
    return pd.DataFrame({"n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output": out})


def _slices(sizes: list[int], most: int) -> Iterator[slice]:
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if k > at and held + size > most:
            yield slice(at, k)
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield slice(at, len(sizes))


def fill_in_middle(docs: DataFrame, seed: int = 7, transformed: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row.

    Of a hundred texts ``transformed`` are rearranged, and of those ``spm`` with the
    suffix first. Draws hang on ``seed`` and doc_id alone.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"), digest.alias("_digest")).select("doc_id", "text", *draws)

    def arrange(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = [t.encode("utf-8") for t in f["text"]]
            draws = f[["h1", "h2", "h3", "h4"]].to_numpy()
            for part in _slices([len(t) for t in raw], SCANNED):
                done = _arranged(raw[part], draws[part], transformed, spm)
                done.insert(0, "doc_id", f["doc_id"].iloc[part].to_numpy())
                yield done

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(arrange, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that was rearranged, from the output and its form."""
    size = len(PREFIX)
    first, second, third = F.lit(1), F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output)), F.locate(MIDDLE, output)
    between = lambda a, b: F.substring(output, a + size, b - a - size)
    one, two, middle = between(first, second), between(second, third), F.substring(output, third + size, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CASE WHEN coalesce(text, '') = '' THEN [] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS u FROM documents),
cut AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM pieces
"""
