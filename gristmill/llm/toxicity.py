"""Toxicity by a subsequence string kernel with Nystrom landmarks and a linear SVM.

The kernel of two words sums over their common subsequences of three letters,
each weighted by decay ** span, for spans up to six: letters may be dropped in
between or put in. Accents and look-alike digits are folded, marks inside a word
drop out, and single letters set apart by spaces are joined, so gapped and
inserted-character spellings stay close to the word they hide.

Training takes a bounded sample of labelled documents and works on the words of
their sentences. Words that stand in toxic documents only, between many
different neighbours, are the positive witnesses; a document that is copied often
counts once, as neighbours that a single document gives are not counted, nor are
words far rarer than the strongest. Words of the other documents are negatives. Some of both
become landmarks, the kernel with them gives Nystrom features, and a linear SVM
is fitted, twice more with the negatives it got wrong. Every positive is also learnt
with a letter put in at each place, so that such spellings fall on its side. The word that scores
highest decides its sentence, and the highest sentence its document.

Scoring is vectorised: with explicit subsequence features the SVM is one weight
per three letters. A bound on the normalised score, computed for all words at
once, leaves a few, which are scored exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.arrow_text import find_words, text_slices
from gristmill.llm.storage import send_code, shared_value, written

SPAN, DECAY = 6, 0.9
#: Offsets of the second and third letter of a subsequence, and its weight.
STEPS = [(a, b, DECAY ** (b + 1)) for a, b in combinations(range(1, SPAN), 2)]
CODES = 27  # letters, and one for any other character of a word
#: Labelled documents used for training at most.
SAMPLE = 8_000
#: Longest word looked at as one; longer ones are cut into overlapping parts.
WORD = 40

_SPREAD = regex.compile(r"(?<!\S)(?:\pL[ \t]){2,}\pL(?!\S)")
#: Letters keep their number 1 to 26, white space ends a word, other ASCII drops out, the rest is 27.
CODE_OF = np.full(256, CODES, np.uint8)
CODE_OF[:128] = 0
CODE_OF[97:123] = np.arange(1, 27)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(b"\t\n\x0b\x0c\r ")] = True


def _fold_column(texts: pa.Array) -> pa.Array:
    """Lower case, and letters set apart by single spaces joined."""
    out = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    spread = pc.match_substring_regex(out, r"(?:^|\s)\pL[ \t]\pL[ \t]\pL(?:\s|$)")
    if pc.any(spread).as_py():
        rows = out.to_pylist()
        for k in np.flatnonzero(spread.to_numpy(zero_copy_only=False)):
            rows[k] = _SPREAD.sub(lambda m: m.group().replace(" ", "").replace("\t", ""), rows[k])
        out = pa.array(rows, pa.large_string())
    return out


# UTF-8 second bytes after 0xC3 (Latin letters with accents), as folded letters
_AFTER_C3 = np.full(256, CODES, np.uint8)
for _c, _f in zip("àáâãäåçèéêëìíîïñòóôõöùúûüýÿß", "aaaaaaceeeeiiiinooooouuuuyys", strict=True):
    _AFTER_C3[_c.encode()[1]] = ord(_f) - 96
_LOOKS = np.zeros(256, np.uint8)
for _c, _f in zip("013457@$", "oieastas", strict=True):
    _LOOKS[ord(_c)] = ord(_f) - 96
CODE_OF = np.where(_LOOKS > 0, _LOOKS, CODE_OF).astype(np.uint8)


def coded_words(texts: pa.Array):
    """Slices of (first row, letter codes of all words joined, word bounds, row of each word)."""
    for first, data, offsets in text_slices(_fold_column(texts)):
        words = find_words(data, offsets, _IS_SPACE)
        codes = CODE_OF[data]
        lead = data == 0xC3
        after = np.flatnonzero(lead[:-1]) + 1
        codes[after] = _AFTER_C3[data[after]]
        drop = lead | (((data & 0xC0) == 0x80) & ~np.concatenate([[False], lead[:-1]]))
        keep = (codes > 0) & ~drop
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(keep, out=before[1:])
        yield first, codes[keep], before[words.starts], before[words.ends], words.row


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, weight) of the subsequences of one word, equal ones summed."""
    index, weight = [], []
    for a, b, w in STEPS:
        n = len(codes) - b
        if n > 0:
            index.append((codes[:n].astype(np.int64) * 28 + codes[a : a + n]) * 28 + codes[b : b + n])
            weight.append(np.full(n, w))
    if not index:
        return np.zeros(0, np.int64), np.zeros(0)
    index, at = np.unique(np.concatenate(index), return_inverse=True)
    return index, np.bincount(at, weights=np.concatenate(weight), minlength=len(index))


def _codes(word: str) -> np.ndarray:
    return np.array([ord(c) - 96 if "a" <= c <= "z" else CODES for c in word], np.uint8)


def _put_in(codes: np.ndarray, times: int) -> list[np.ndarray]:
    """The word with one letter put in, ``times`` at every place inside it. The letters
    follow from the word, so that a model is the same whenever it is fitted."""
    letters = np.random.default_rng(codes.astype(np.uint32)).integers(1, 27, (len(codes), times))
    return [np.insert(codes, k, x).astype(np.uint8) for k in range(1, len(codes)) for x in letters[k]]


def _far_apart(features: np.ndarray, most: int) -> list[int]:
    """Rows to start with the first and always add the one least like those chosen."""
    chosen, near = [0], features @ features[0]
    while len(chosen) < min(most, len(features)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, features @ features[chosen[-1]])
    return chosen


def _matrix(words: list[np.ndarray]) -> np.ndarray:
    """Unit-length subsequence features of the words, dense rows."""
    out = np.zeros((len(words), 28**3), np.float32)
    for k, w in enumerate(words):
        index, weight = _features(w)
        norm = np.sqrt((weight**2).sum())
        if norm:
            out[k, index] = weight / norm
    return out


def _kernel(words: list[np.ndarray], landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel of each word with each landmark (rows of features)."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for k, w in enumerate(words):
        index, weight = _features(w)
        norm = np.sqrt((weight**2).sum())
        if norm:
            out[k] = landmarks[:, index] @ (weight / norm)
    return out


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # by subsequence; empty when there was nothing to learn
    bias: float
    slope: float
    offset: float


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 300, cost: float = 50.0) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, classes weighted equally, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(min(rounds, 30)):
        active = y * (x @ w) < 1
        xa, c = x[active], cost / len(y) * share[active]
        new = np.linalg.solve(ridge + (xa * c[:, None]).T @ xa, (xa * c[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def _word_rows(chosen: DataFrame) -> DataFrame:
    """toxic, doc (hash of the text: exact copies are one), left and word of every word."""
    words = F.expr(r"filter(split(trim(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿß', 'aaaaaaceeeeiiiinooooouuuuyys'), '[^\\p{L}]+', ' ')), ' '), x -> x != '')")
    pairs = F.transform(F.array(words), lambda x: F.arrays_zip(F.concat(F.array(F.lit("")), x).alias("left"), x.alias("word")))
    rows = chosen.select("toxic", F.xxhash64("text").alias("doc"), F.explode(pairs[0]).alias("p"))
    return rows.select("toxic", "doc", "p.left", "p.word").where(F.length("word").between(3, WORD))


def _word_table(rows: DataFrame) -> DataFrame:
    """word, n_clean, n_toxic, n_contexts, n_in_one: occurrences by label, distinct
    words before it in toxic documents, and the most of them in any one document."""
    bad = F.col("toxic") == 1
    counts = rows.groupBy("word", "left", "toxic").agg(F.count("*").alias("n"))
    single = rows.where(bad).groupBy("word", "doc").agg(F.count_distinct("left").alias("n"))
    single = single.groupBy("word").agg(F.max("n").alias("n_in_one"))
    totals = counts.groupBy("word").agg(
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("n_toxic"),
        F.coalesce(F.sum(F.when(~bad, F.col("n"))), F.lit(0)).alias("n_clean"),
        F.count(F.when(bad, True)).alias("n_contexts"),
    )
    return totals.join(single, "word", "left").fillna(0, ["n_in_one"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, salt: str = "toxicity", landmarks: int = 512, witnesses: int = 400, clean_words: int = 6_000, rare: float = 0.1, put_in: int = 3) -> ToxicityModel:
    """Learn from at most about ``sample`` labelled documents, chosen by a hash of
    their key. Labels and keys that are null are left out; repeated label rows
    count once, as toxic if any is. Without both classes nothing is learnt and
    every score is 0.

    What bounds the model, all by words of the sample: at most ``witnesses`` words of
    toxic documents, those of most contexts, each with at least the share ``rare`` of the
    contexts that the first has, and learnt with ``put_in`` letters at every place;
    ``clean_words`` words of other documents, chosen by a hash, and the 500 that then
    look worst, twice; ``landmarks`` of all these for the Nystrom features.
    """
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("toxic"))
    total = marked.count()
    empty = ToxicityModel(np.zeros(0), 0.0, 1.0, 0.0)
    if not total:
        return empty
    unit = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = marked.where(unit < min(1.0, sample / total))
    chosen = written(docs.select(F.col(key), F.col(text).alias("text")).join(picked, key).select("toxic", "text"), "labelled")
    rows = _word_rows(chosen)
    table = written(_word_table(rows), "words")
    sizes = table.agg(F.count("*"), F.sum("n_toxic"), F.sum("n_toxic") + F.sum("n_clean")).first()
    if not sizes[0] or not 0 < sizes[1] < sizes[2]:
        return empty
    # so many contexts that less than one word is expected to have them in toxic documents alone by chance
    least = max(3, math.ceil(math.log(sizes[0]) / math.log(sizes[2] / sizes[1])))
    seen = table.where((F.col("n_clean") == 0) & (F.col("n_contexts") - F.col("n_in_one") >= least))
    positive = seen.orderBy(F.desc("n_contexts"), "word").limit(witnesses).select("word", "n_contexts").collect()
    positive = [r["word"] for r in positive if r["n_contexts"] >= rare * positive[0]["n_contexts"]]
    negative = table.where("n_clean > 0").orderBy(F.xxhash64("word", F.lit(salt))).limit(clean_words).collect()
    if not positive or not negative:
        return empty
    good = [_codes(word) for word in positive]
    bad = [_codes(r["word"]) for r in negative]
    clean = {c.tobytes() for c in bad}
    good += [v for c in good for v in _put_in(c, put_in) if v.tobytes() not in clean]
    # landmarks: spellings of witnesses that differ most, and the clean words most like them
    features = _matrix(good)
    own = features[_far_apart(features, landmarks // 2)]
    likeness = _kernel(bad, own).max(1)
    base = np.vstack([own, _matrix([bad[k] for k in np.argsort(-likeness, kind="stable")[: landmarks - len(own)]])])
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    use = values > 1e-6
    root = vectors[:, use] / np.sqrt(values[use])
    train, y = good + bad, np.array([1.0] * len(good) + [-1.0] * len(bad))
    x = _kernel(train, base) @ root
    w, bias = _svm(x, y)
    send_code(docs.sparkSession)
    # a sentence is as toxic as its worst word: of clean sentences the words that look worst
    # are learnt as clean, of toxic ones those that look worse than any clean word as toxic
    for _ in range(2):
        model = ToxicityModel((root @ w) @ base, bias, 1.0, 0.0)
        worst = _hard_words(chosen.where("toxic = 0"), model)
        highest = max((m for _, m in worst), default=0.0)
        telling = [(raw, m) for raw, m in _hard_words(chosen.where("toxic = 1"), model) if m > highest]
        known = {c.tobytes() for c in train}
        more = [(np.frombuffer(raw, np.uint8), sign) for found, sign in ((worst, -1.0), (telling, 1.0)) for raw, _ in found if raw not in known]
        if not more:
            break
        train, y = train + [c for c, _ in more], np.concatenate([y, [sign for _, sign in more]])
        x = np.vstack([x, _kernel([c for c, _ in more], base) @ root])
        w, bias = _svm(x, y)
    model = ToxicityModel((root @ w) @ base, bias, 1.0, 0.0)
    scored = score(chosen.select("toxic", "text"), model, "text", ("toxic",)).select("toxic", "margin").toPandas()
    slope, offset = _platt(scored["margin"].to_numpy(), scored["toxic"].to_numpy())
    return ToxicityModel(model.weights.astype(np.float32), model.bias, slope, offset)


def _platt(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic curve through the margins, by Newton steps with a little ridge."""
    x = np.stack([margin, np.ones(len(margin))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - toxic) + 1e-2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _margins(codes, starts, ends, model: ToxicityModel, floor: float):
    """(word number, its codes, margin) of the words whose margin can pass ``floor``."""
    if not len(starts) or not len(model.weights):
        return
    n = np.zeros(len(codes))
    norm = np.zeros(len(codes))
    wide = codes.astype(np.int32)
    last = np.repeat(ends, ends - starts)  # end of the word at each letter: words are contiguous
    for a, b, w in STEPS:
        m = len(codes) - b
        if m <= 0:
            continue
        inside = np.arange(m) + b < last[:m]
        index = (wide[:m] * 28 + wide[a : a + m]) * 28 + wide[b : b + m]
        n[:m] += np.where(inside, w * model.weights[index], 0)
        norm[:m] += np.where(inside, w * w, 0)
    sums, norms = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(norm)])
    top, least = sums[ends] - sums[starts], np.sqrt(norms[ends] - norms[starts])
    # equal subsequences only lengthen the word's vector, so this is never below the margin of a positive word
    bound = np.divide(top, least, out=np.zeros(len(top)), where=least > 0) + model.bias
    long = ends - starts > WORD
    known = {}
    for k in np.flatnonzero((bound > floor) | long):
        word = codes[starts[k] : ends[k]]
        raw = word.tobytes()
        if raw not in known:
            parts = [word] if len(word) <= WORD else [word[s : s + WORD] for s in range(0, len(word) - WORD // 2, WORD // 2)]
            best = -np.inf
            for part in parts:
                index, weight = _features(part)
                size = np.sqrt((weight**2).sum())
                best = max(best, (model.weights[index] @ weight) / size + model.bias if size else model.bias)
            known[raw] = best
        yield k, raw, known[raw]


#: Margins below the boundary of the classes count as this.
FLOOR = 0.0


def _hard_words(docs: DataFrame, model: ToxicityModel, most: int = 500) -> list[tuple[bytes, float]]:
    """Codes and margins of the words of ``docs`` with the largest margins."""
    frame = docs.select("text")

    def of(batches):
        for batch in batches:
            for _, codes, starts, ends, _ in coded_words(batch.column(0)):
                seen = {raw: m for _, raw, m in _margins(codes, starts, ends, model, FLOOR) if m > FLOOR}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[:WORD].hex() for r in seen], pa.string()), pa.array(list(seen.values()), pa.float64())],
                    ["word", "margin"],
                )

    found = frame.mapInArrow(of, "word string, margin double").groupBy("word").agg(F.max("margin").alias("margin"))
    return [(bytes.fromhex(r["word"]), r["margin"]) for r in found.orderBy(F.desc("margin"), "word").limit(most).collect()]


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, ``margin`` of the most toxic word and ``score`` (0 to 1).

    Empty and null texts have the floor margin, as do texts without any suspicious
    word; a model that learnt nothing scores 0. Other columns are left behind.
    """
    keys = list(keys)
    shared = shared_value(docs.sparkSession, model)
    frame = docs.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keys).schema)

    def of(batches):
        fitted = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            margin = np.full(len(texts), FLOOR)
            for first, codes, starts, ends, row in coded_words(texts):
                for k, _, m in _margins(codes, starts, ends, fitted, FLOOR):
                    margin[first + row[k]] = max(margin[first + row[k]], m)
            value = 1 / (1 + np.exp(-np.clip(fitted.slope * margin + fitted.offset, -30, 30)))
            value = value if len(fitted.weights) else np.zeros(len(texts))
            own = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, pa.array(margin), pa.array(value)], [*keys, "margin", "score"])

    return frame.mapInArrow(of, f"{schema}, margin double, score double")
