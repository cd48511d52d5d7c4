"""Fill-in-the-middle: texts cut at two unit boundaries and put in another order.

Each code point has a character class; the first letter of a run of letters has its
own. A wavelet matrix over the classes of many texts answers how often a class occurs
up to a point. The classes that begin a unit add up to the units begun up to a point,
so a text's units are a difference of two such counts, and a cut after a number of
units is found by bisection on them, for all texts of a slice at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.arrow_text import text_slices
from gristmill.llm.storage import send_code
from gristmill.llm.wavelet import WaveletMatrix

INNER, FIRST, DIGIT, BLANK, BREAK, SIGN, BEYOND, CONTROL = range(8)
N_BITS = 3
#: Classes that begin a unit: letter runs and single other characters; characters; letter runs alone.
UNITS = {
    "token": (FIRST, DIGIT, BLANK, BREAK, SIGN, BEYOND, CONTROL),
    "character": (INNER, FIRST, DIGIT, BLANK, BREAK, SIGN, BEYOND, CONTROL),
    "word": (FIRST,),
}
MARKS = ("<P>", "<S>", "<M>")

_CLASS = np.full(129, BEYOND, np.uint8)
_CLASS[:128] = SIGN
_CLASS[:32] = CONTROL
_CLASS[127] = CONTROL
_CLASS[[9, 32]] = BLANK
_CLASS[[10, 13]] = BREAK
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = FIRST


def classes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of each code point; texts begin at ``starts``."""
    found = _CLASS[np.minimum(points, 128)]
    inner = np.zeros(len(found), bool)
    inner[1:] = (found[1:] == FIRST) & (found[:-1] == FIRST)
    inner[starts[starts < len(found)]] = False
    found[inner] = INNER
    return found


class Boundaries:
    """Units begun among the first ``p`` code points of a slice of texts."""

    def __init__(self, symbols: np.ndarray, unit: str):
        self.matrix = WaveletMatrix(symbols, N_BITS)
        begin = UNITS[unit]
        rest = [c for c in range(1 << N_BITS) if c not in begin]
        # the shorter of the two sums: of the classes that begin a unit, or of the others
        self.others = len(rest) < len(begin)
        self.counted = rest if self.others else begin

    def begun(self, p: np.ndarray) -> np.ndarray:
        n = sum((self.matrix.rank(c, p) for c in self.counted), np.zeros(len(p), np.int64))
        return p - n if self.others else n

    def cuts(self, starts: np.ndarray, ends: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Ends of the first ``units`` units of each text: the largest point up to
        which no more have begun; the text's start for none."""
        wanted = self.begun(starts) + units
        low, high = starts.copy(), ends.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            fits = self.begun(middle) <= wanted
            low = np.where(open_ & fits, middle, low)
            high = np.where(open_ & ~fits, middle - 1, high)
        return np.where(units == 0, starts, low)


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a text, from the SHA-256 of seed and key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transform(
    docs: DataFrame,
    keys: list[str],
    key: str = "doc_id",
    text: str = "text",
    seed: int = 1,
    percent: int = 90,
    spm_percent: int = 20,
    unit: str = "token",
) -> DataFrame:
    """keys, ``output``, ``form`` (plain, psm or spm), ``n`` units, ``prefix_chars`` and
    ``middle_chars`` (null if plain).

    ``percent`` of the texts are cut, ``spm_percent`` of these with the suffix first;
    ``key`` and ``seed`` alone decide, so equal keys are cut alike. A null key counts as
    empty. Null and empty texts, and those that hold a mark, stay plain. Other columns
    are left behind; give those to keep as ``keys``. Repeated rows give repeated results.
    Memory of a task is bounded by an Arrow batch and the longest text.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    send_code(docs.sparkSession)
    frame = docs.select(*keys, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"), F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keys).schema)
    columns = ["output", "form", "n", "prefix_chars", "middle_chars"]

    def of(batches):
        for batch in batches:
            texts = batch.column(len(keys) + 1)
            names = batch.column(len(keys))
            made: list[list] = [[] for _ in columns]
            for row, data, offsets in text_slices(texts):
                whole = data.tobytes().decode()
                points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
                begins = np.zeros(len(data) + 1, np.int64)  # code points before each byte
                np.cumsum(data & 0xC0 != 0x80, out=begins[1:])
                edges = begins[offsets]
                starts, ends = edges[:-1], edges[1:]
                units = Boundaries(classes(points, starts), unit)
                n = units.begun(ends) - units.begun(starts)
                drawn = np.array([draws(seed, names[row + k].as_py()) for k in range(len(n))], np.int64)
                pair = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
                first, second = (units.cuts(starts, ends, pair[:, k]) for k in (0, 1))
                for k, (start, a, b, end) in enumerate(zip(*(x.tolist() for x in (starts, first, second, ends)), strict=True)):
                    body = whole[start:end]
                    if not body or drawn[k, 2] % 100 >= percent or any(m in body for m in MARKS):
                        values = (body, "plain", int(n[k]), None, None)
                    else:
                        prefix, middle, suffix = whole[start:a], whole[a:b], whole[b:end]
                        if drawn[k, 3] % 100 < spm_percent:
                            form, output = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
                        else:
                            form, output = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
                        values = (output, form, int(n[k]), a - start, b - a)
                    for column, value in zip(made, values, strict=True):
                        column.append(value)
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(v, t) for v, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *arrays], [*keys, *columns])

    return frame.mapInArrow(of, f"{schema}{', ' if keys else ''}output string, form string, n bigint, prefix_chars bigint, middle_chars bigint")


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` made ``output`` of."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)))
        .when(form == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )
