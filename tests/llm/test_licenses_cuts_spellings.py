"""License join, fill-in-the-middle and spelling variants against brute force, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF, plan_of
from gristmill.llm import fill_in_middle, licenses, queries, spellings
from gristmill.llm.license_texts import PHRASES, TEMPLATES
from gristmill.llm.wavelet import WaveletMatrix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIT = TEMPLATES[2][1]
LONG = "\n".join(f"zeile {k % 977} " + "wört " * 40 for k in range(6_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t \n"), (4, "Under the MIT License"), (5, "under\nthe\n\nmit --- license under the mit license"),
    (6, LONG + "\nLicensed under CC BY-NC 4.0."), (7, "Apache License, Version 2.0"), (7, "Apache License, Version 2.0"),
    (None, "licensed under cc by-sa 4.0"), (8, "intro\n\n" + MIT.replace(" software ", "\nsoftware ") + "\n\nrest"),
    (9, "é 🙂 İK under the mit licenſe <P> <S"), (10, "a<S>b"), (11, "Kind of a\x00b\x0bc × ÷ ÀÉ"), (12, "ab1 cd\r\nef🙂g"),
    (13, " ".join(["wording"] * 6 + ["wordings"] * 20 + ["wordin"] * 3 + ["Ärger"] * 4 + ["ärger"] * 3)),
    (14, "This work is licensed under the GNU General Public License, version 3.\nxx " + TEMPLATES[8][1] + " yy"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like the operators' own."""
    frame = spark.createDataFrame(ODD, "doc_id long, text string")
    names = ("word", "n", "key", "form", "output", "first", "labels", "matches", "words", "score", "row", "rank", "own")
    return frame.withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="module")
def both(docs, odd):
    return docs.select("doc_id", "text").unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10_000).select("doc_id", "text"))


def as_counter(rows):
    return collections.Counter(tuple(r) for r in rows)


# 11 license scans


def words_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def blocks_by_hand(text):
    lines = [words_by_hand(x) for x in (text or "").split("\n")]
    run = []
    for i, ws in enumerate([*lines, []], 1):
        if ws:
            yield i, i, set(ws)
            run.append(i)
        else:
            if len(run) > 1:
                yield run[0], run[-1], {w for k in run for w in lines[k - 1]}
            run = []


def licenses_by_hand(text, wordings, threshold):
    words = words_by_hand(text)
    hits = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    templates = {(label, tuple(licenses.words_of(t))) for label, t in wordings}
    matches = set()
    for first, last, block in blocks_by_hand(text):
        fits = [(len(block & set(t)) / len(t), len(block & set(t)), label) for label, t in templates]
        fits = [f for f in fits if f[0] >= threshold - 1e-9]
        matches |= {(first, last, label, fit) for fit, n, label in fits if (fit, n) == max(f[:2] for f in fits)}
    labels = sorted({x[1] for x in hits} | {m[2] for m in matches})
    return len(words), sorted(hits), sorted(matches), labels, 1.0 if hits else max([m[3] for m in matches], default=0.0)


@pytest.mark.parametrize(("wordings", "threshold"), [(TEMPLATES, 0.9), (TEMPLATES, 0.6), ([("x", "a b c the of"), ("y", "the of and")], 0.5)])
def test_license_join_equals_all_blocks_with_all_templates(both, wordings, threshold):
    got = licenses.scan(both, wordings=wordings, threshold=threshold).select("doc_id", "__licenses.*").collect()
    made = as_counter(
        (r["doc_id"], r["n_words"], str(sorted(map(tuple, r["hits"]))), str(list(map(tuple, r["matches"]))), str(r["labels"]), r["score"])
        for r in got
    )
    hand = [(r["doc_id"], licenses_by_hand(r["text"], wordings, threshold)) for r in both.select("doc_id", "text").collect()]
    assert made == as_counter((i, h[0], str(h[1]), str(h[2]), str(h[3]), h[4]) for i, h in hand)


def test_licenses_of_wrapped_text_and_odd_rows(odd):
    got = {r["doc_id"]: r["__licenses"] for r in licenses.scan(odd).collect()}
    assert got[8]["labels"] == ["mit"] and [(m["first"], m["last"]) for m in got[8]["matches"]] == [(3, 4)]
    assert got[1]["n_words"] == 0 and got[2]["labels"] == [] and got[3]["score"] == 0
    assert got[None]["labels"] == ["cc-by-sa"] and got[14]["labels"] == ["gpl-3"] and got[9]["labels"] == []
    assert got[5]["hits"] and got[6]["labels"] == ["cc-by-nc"]


def test_licenses_without_rows_templates_or_phrases(odd):
    assert licenses.scan(odd.where("false")).count() == 0
    none = licenses.scan(odd, wordings=[], phrases={}).select("__licenses.labels").collect()
    assert len(none) == len(ODD) and all(r["labels"] == [] for r in none)
    with pytest.raises(ValueError, match="threshold"):
        licenses.scan(odd, threshold=0.0)


def test_license_plan_has_no_python(docs):
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan_of(licenses.scan(docs)))


# 12 fill-in-the-middle


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        p = np.arange(n + 1)
        for c in range(8):
            assert (WaveletMatrix(symbols, 3).rank(c, p) == [(symbols[:k] == c).sum() for k in p]).all()


def cut_by_hand(doc_id, text, unit=r"[A-Za-z]+|[^A-Za-z]", percent=90):
    text = text or ""
    units = re.findall(unit, text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return text, "plain", len(units), None, None
    if h[3] % 100 < 20:
        return f"<S>{s}<P>{p}<M>{m}", "spm", len(units), len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", "psm", len(units), len(p), len(m)


def test_cuts_equal_a_list_of_units_and_restore(both):
    got = fill_in_middle.transform(both, ["doc_id", "text"])
    rows = got.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == (r["text"] or "") for r in rows)
    made = as_counter((r["doc_id"], r["output"], r["form"], r["n"], r["prefix_chars"], r["middle_chars"]) for r in rows)
    assert made == as_counter((r["doc_id"], *cut_by_hand(r["doc_id"], r["text"])) for r in both.collect())
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_cuts_between_characters_and_words(both):
    chars = fill_in_middle.transform(both, ["doc_id", "text"], unit="character", percent=100).where("form <> 'plain'").collect()
    for r in chars:
        assert r["n"] == len(r["text"]) and r["output"] == cut_by_hand(r["doc_id"], r["text"], r"(?s:.)", 100)[0]
    for r in fill_in_middle.transform(both, ["text"], "text", unit="word", percent=100).where("form <> 'plain'").collect():
        begins = {m.start() for m in re.finditer("[A-Za-z]+", r["text"])} | {0, len(r["text"])}
        assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= begins and r["n"] == len(re.findall("[A-Za-z]+", r["text"]))


def test_cuts_of_no_rows_and_clashing_names(odd):
    assert fill_in_middle.transform(odd.where("false"), ["doc_id"]).count() == 0
    assert fill_in_middle.transform(odd, ["doc_id", "word", "key"]).columns[:3] == ["doc_id", "word", "key"]
    assert fill_in_middle.transform(odd, []).count() == len(ODD)
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle.transform(odd, [], unit="page")


# 13 spelling variants


def counts_by_hand(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def variants_by_hand(counts):
    gaps = collections.defaultdict(set)  # a word without one character, and where
    for w in counts:
        for k in range(len(w)):
            gaps[w[:k], w[k + 1 :]].add(w)
    near = {w: set() for w in counts}
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    for w in counts:
        for k in range(len(w)):
            shorter = w[:k] + w[k + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, counts[w], len(near[w]), counts.get(form[w])


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_spellings_equal_all_pairs(both):
    hand = counts_by_hand((r["doc_id"], r["text"]) for r in both.select("doc_id", "text").collect())
    got = spellings.group_spellings(both).select(*COLUMNS).collect()
    assert len(got) > 2_000 and as_counter(got) == as_counter(variants_by_hand(hand))


@pytest.mark.parametrize("group_pairs", [1, 20, 4096])
def test_crowded_chunks_lose_nothing(spark, group_pairs):
    rng = random.Random(group_pairs)
    words = {"".join(rng.choices("abé", k=rng.randint(5, 9))) for _ in range(1500)} | {"handle" + c for c in "abcdefghijklmnop"}
    counts = {w: rng.randint(3, 60) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spellings.variants(frame, group_pairs=group_pairs).select(*COLUMNS).collect()
    assert as_counter(got) == as_counter(variants_by_hand(counts))


def test_pairs_are_found_once(spark):
    words = ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "abab", "ababa"]
    pairs = spellings.near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), group_pairs=2).collect()
    assert as_counter((p["a"], p["b"]) for p in pairs) == {
        ("aaaaa", "aaaaaa"): 1, ("aaaaaa", "aaaaaaa"): 1, ("abab", "ababa"): 1, ("ababa", "ababab"): 1, ("ababa", "bababa"): 1,
    }


def test_spellings_of_odd_and_no_rows(odd):
    got = {r["word"]: r for r in spellings.group_spellings(odd, noise=0).collect()}
    assert got["wording"]["form"] == "wordings" and got["wordin"]["root"] == "wordings" and got["wordin"]["form"] == "wording"
    assert got["Ärger"]["n_near"] == 1 and "licensed" in got
    assert spellings.group_spellings(odd.where("false")).count() == 0


def test_registered_queries_have_the_agreed_columns(spark):
    wanted = {
        "op11_license_join": "doc_id n_words n_base first_word last_word base_labels labels score",
        "op12_fill_in_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
        "op13_spelling_chunks": "word form root n n_near form_n",
    }
    for name, columns in wanted.items():
        assert queries.QUERIES[name](spark, SF).columns == columns.split()
