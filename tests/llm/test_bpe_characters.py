"""BPE encoding against the tokenizers library: every code point, and pairs of tokens."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gristmill.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(PATH)


def test_every_code_point_as_the_library_does(vocabulary):
    library, codec = Tokenizer.from_file(PATH), bpe.Codec(vocabulary)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 1 << 16):
        texts = [f"a{c}!{c}" for c in points[k : k + (1 << 16)]]
        wanted = library.encode_batch(texts, add_special_tokens=False)
        for c, (raw, _), e in zip(points[k:], codec.encode(texts), wanted, strict=False):
            assert raw == np.array(e.ids, "<u4").tobytes(), f"U+{ord(c):04X}"


def test_spines_decide_as_merging_does(vocabulary):
    encoder, rng = bpe.TrieEncoder(vocabulary), random.Random(1)
    tokens = [t for t in encoder.open.values() if t >= 0 and encoder.stands(t)]
    short = [t for t in tokens if t < 2000]
    for _ in range(20_000):
        a, b = rng.choice(short), rng.choice(short if rng.random() < 0.5 else tokens)
        assert encoder.compatible(a, b) == (encoder.merged(encoder.symbols(a) + encoder.symbols(b)) == [a, b]), (a, b)


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "x.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="before its parts"):
        bpe.read_vocabulary(str(tmp_path / "x.json"))
