import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from helpers import EDGES, LONG, docs, rows
from pyspark.sql import functions as F

from strandline.llm import bpe, token_counts
from strandline.llm.queries import VOCABULARY

PATH, PATTERN = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE(bpe.read_ranks(PATH), PATTERN, remembered=20_000)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


PARTS = ["a", "b", "é", " ", "  ", "\n", "\r\n", "\t", "1", "23", "the", " the", "ing", "ß", "中文", "'s", "'ll", "😀", "aaaa", "<|endoftext|>", " ", " ", "　", "​", "٣", "ª", "_", "#", "\x00", "\x1f", "\x85"]


def test_ids_equal_the_library(own, library):
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "abcde" * 1500 + "xyz", "é" * 2000, " " * 4000 + "x", "=" * 3001, "", "\n" * 2000])
def test_long_pretokens(own, library, text):
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text) and own.decode(ids).decode() == text
    assert not any(own.words)


def test_memory_is_bounded(own):
    for i in range(500):
        own.encode(f" tok{i}")
    assert 20 < len(own.remember) + len(own.remember.old) <= 200


def test_tables(spark, library):
    df = docs(spark, EDGES)
    got = rows(bpe.digest_table(df, PATH, PATTERN))
    want = sorted((str(r[0]), len(ids := library.encode_ordinary(r[1] or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in EDGES)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    coded = bpe.encode_table(df, PATH, PATTERN)
    decoded = rows(bpe.decode_table(coded, PATH, PATTERN))
    assert sorted((str(r["doc_id"]), bytes(r["content"]).decode()) for r in decoded) == sorted((str(r[0]), r[1] or "") for r in EDGES)
    assert bpe.digest_table(df.where("false"), PATH, PATTERN).count() == 0


def edited(text, todo):
    for at, n, new in todo:
        text = text[:at] + new + text[at + n :]
    return text


def test_counts_follow_random_edits(own, library):
    rng = random.Random(2)
    count, cut = lambda p: len(own.remember[p]), regex.compile(PATTERN)
    for trial in range(60):
        text = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 3, 200, 2000])))
        tree = token_counts.CountTree.of(text, cut, count)
        assert tree.total == len(library.encode_ordinary(text))
        for _ in range(12):
            at, n = rng.randint(0, len(text)), rng.choice([0, 1, 5, 400, 10**6])
            new = "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 4, 600])))
            want = edited(text, [(at, n, new)])
            tree = token_counts.CountTree.stored(tree.packed())  # as read from a table
            text = tree.edit(text, at, n, new, cut, count)
            assert text == want and tree.total == len(library.encode_ordinary(text)), (trial, at, n, new)
            assert tree.heaps[0][1] == len(text) and tree.n_pieces == len(cut.findall(text))
            for heap in tree.heaps:
                assert all(heap[k] == heap[2 * k] + heap[2 * k + 1] for k in range(1, tree.base))


def test_numbers_of_tokens_by_pre_token(own, library):
    """Short and long pre-tokens, remembered in generations that turn over."""
    rng = random.Random(9)
    lengths = token_counts.Lengths(own, most=2_000)
    for _ in range(3000):
        piece = "".join(rng.choice(PARTS) for _ in range(rng.choice([1, 1, 2, 5, 40])))
        assert lengths[piece] == len(own.merge(piece.encode())), piece
    assert lengths.held <= 2_000 + token_counts.LENGTH_BYTES + 100 and lengths["the"] == len(library.encode_ordinary("the"))


def test_edits_encode_little(own):
    text, cut, count = "some words of text " * 20_000, regex.compile(PATTERN), lambda p: len(own.remember[p])
    tree = token_counts.CountTree.of(text, cut, count)
    tree.edit(text, len(text) // 2, 3, "new", cut, count)
    assert tree.reencoded <= 4 * token_counts.BLOCK


def test_count_table(spark, library):
    df = docs(spark, EDGES)
    got = {str(r["doc_id"]): r for r in rows(token_counts.count_edits(df, PATH, PATTERN))}
    for i, text, *_ in EDGES:
        text = text or ""
        for at, n, new in ((0, 0, "Note: "), (None, 12, " revised wording"), (-30, 7, "")):
            size = len(EDGES_TEXT[i]) if i is not None else 0
            at = size // 2 if at is None else max(0, size - 30) if at else 0
            text = edited(text, [(at, n, new)])
        if i is not None:
            assert (got[str(i)]["n_tokens"], got[str(i)]["n_tokens_edited"]) == (len(library.encode_ordinary(EDGES_TEXT[i])), len(library.encode_ordinary(text)))
    assert got["6"]["n_reencoded"] < 800 and len(LONG) > 100_000
    assert got["None"]["n_tokens"] == got["None"]["n_tokens_edited"] and got["None"]["n_reencoded"] == 0
    assert len(rows(token_counts.count_edits(df, PATH, PATTERN))) == len(EDGES)
    assert token_counts.count_edits(df.where("false"), PATH, PATTERN).count() == 0


EDGES_TEXT = {r[0]: r[1] or "" for r in EDGES}


def test_stored_trees_take_a_table_of_edits(spark, library):
    """Twice over, the second time from the trees that the first left; rows of one id with two texts too."""
    rng = random.Random(4)
    texts = {i: "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 40, 3000]))) for i in range(30)}
    df = docs(spark, [*texts.items(), (7, "another text of 7"), (7, texts[7])])
    now = {**texts}
    trees, table = token_counts.plant(df, PATH, PATTERN), df
    for _ in range(2):
        todo = [(i, k, rng.randint(0, 50), rng.choice([0, 3, 80]), "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 2, 300])))) for i in range(0, 30, 2) for k in range(3)]
        out = token_counts.apply_edits(table, trees, spark.createDataFrame(todo, "doc_id long, seq int, at int, removed int, inserted string"), PATH, PATTERN)
        got = rows(out)
        for i, _, at, n, new in todo:
            now[i] = edited(now[i], [(min(at, len(now[i])), n, new)])
        assert all(r["n_tokens_edited"] == len(library.encode_ordinary(r["text"])) == token_counts.CountTree.stored(r["tree"]).total for r in got)
        assert len(got) == 32 and all(r["text"] == now[r["doc_id"]] for r in got if r["doc_id"] != 7)
        assert all(r["n_reencoded"] == 0 for r in got if r["doc_id"] % 2)
        table = spark.createDataFrame([(r["doc_id"], r["text"]) for r in got], "doc_id long, text string")
        trees = out.select("doc_id", F.xxhash64("text").alias("mark"), "tree")
