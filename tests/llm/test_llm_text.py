"""Quality rules, secrets, packing and pieces against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from conftest import SF001
from llm_cases import DOCS, LONG, docs, no_docs, rows
from platelens.llm import packing, pieces, queries, repetition, secret_scan
from platelens.llm.queries import PIECE_MODEL

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _repeats(words, least=8):
    """Longest repeat from each position, by definition."""
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            if i != j:
                n = 0
                while max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                    n += 1
                best = max(best, n)
        out.append(best if best >= least else 0)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=4))
def test_suffix_array_repeats(texts):
    flat, ends, want = [], [], []
    for t, words in enumerate(texts):
        flat += [t * 10 + "abc".index(w) for w in words]
        want += _repeats(words)
    at = 0
    for words in texts:
        at += len(words)
        ends += [at] * len(words)
    assert repetition.longest_repeats(np.array(flat, np.int64), np.array(ends, np.int64)).tolist() == want


def _measured(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORDS.search(x):
            dup += x in seen
            seen.add(x)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_quality_rules_edges(spark):
    extra = [(20, " ".join(map(str, range(100))) + " #* <x> " + " ".join(map(str, range(10))), "en", "s"),
             (21, " ".join(map(str, range(70))) * 2 + " z " * 3 + " ".join(map(str, range(1000, 1900))), "en", "s")]
    data = [(r[0], r[1]) for r in DOCS + extra]
    df = docs(spark, True).unionByName(spark.createDataFrame(extra, docs(spark).schema), allowMissingColumns=True)
    got = repetition.judged(df)
    assert rows(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) \
        == sorted(((i, *_measured(t)) for i, t in data), key=repr)
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert kept[20] and not kept[21] and not kept[6]      # 21: one repeat of 70 words in a long text
    assert repetition.judged(no_docs(spark)).collect() == []


def _base(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in secret_scan._ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["PassWord", "token", "api_key", "apikey", "secret", '"', "'", " ", ":", "=", "é", "\n", "${k}",
                                 "AKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "x", "k", "+", "ſecret"]), max_size=24))
def test_base_spans(parts):
    text = "".join(parts)
    got = [s for s in secret_scan.spans_of(text) if s[2] != "literal"]
    assert got == [(s, e, k) for s, _, k, e in _base(text)]


@pytest.mark.parametrize("text,want", [
    ('db_password = "s3cr3tV4lue99"', ["s3cr3tV4lue99"]),
    ('x = "s3cr3tV4lue99"\nAUTH_TOKEN = x', ["s3cr3tV4lue99"]),
    ('a = "s3cr3t"\nb = a + "V4lue99!"\nclientSecret: ${b}', ["s3cr3t", "V4lue99!"]),
    ('{"privateKey": "Zm9vYmFyMTIz"}', ["Zm9vYmFyMTIz"]), ("password = changeme", []), ("name = 'Zm9vYmFyMTIz'", []),
    ("the token: is here for all", []), ("", []), ("x = x\npassword = x", []), ("password=", []),
])
def test_lexed_literals(text, want):
    assert [text[s:e] for s, e in secret_scan.literal_spans(text)] == want


V = "s3cr3tV4lue99"


@pytest.mark.parametrize("text,want", [
    (f'api_key: str = "{V}"', [V]), (f'const token: string = "{V}";', [V]), (f"api_key: Optional[Dict[str, str]] = '{V}'", [V]),
    (f'let token: string | undefined = "{V}"', [V]), (f'api_key:str="{V}"', [V]), (f'token?: string = "{V}"', [V]),
    (f'let secret: &\'static str = "{V}"', [V]), (f'var dbPassword string = "{V}"', [V]), (f'char pwd[] = "{V}";', [V]),
    (f'conf["db_password"] = "{V}"', [V]), ("pwd: Zx81aaQ3kP9=", ["Zx81aaQ3kP9="]), (f"pwd: {V}", [V]),
    ('secret = "s3cr3t" +\n    "V4lue99!"', ["s3cr3t", "V4lue99!"]), ('secret = "s3cr3t"\n    + "V4lue99!"', ["s3cr3t", "V4lue99!"]),
    ('secret = "s3cr3t" \\\n "V4lue99!"', ["s3cr3t", "V4lue99!"]), ('a = "s3cr3t"\npwd = a+"V4lue99!"', ["s3cr3t", "V4lue99!"]),
    (f'+pwd = "{V}"\n+name = "Zm9vYmFyMTIz"', [V]), (f'pwd: "{V}"\n+ Zm9vYmFyMTIz = 3', [V]),
    ('secret = (\n  "s3cr3t"  # one\n  "V4lue99!"\n)', ["s3cr3t", "V4lue99!"]), (f'secret = (("{V}"))', [V]),
    (f'secret =\n  "{V}"', [V]), (f'secret:\n  "name": "{V}"', []), (f"pwd: |\n  {V}\n", [V]),
    (f'secret = """{V}"""', [V]), (f"secret = '''\n{V}\n'''", [V]), (f"secret = `{V}`", [V]), (f'secret = b"{V}"', [V]),
    (f'text = """\npwd = "{V}"\n"""', [V]),
    (f'pwd = os.getenv("DB_PASSWORD_1", "{V}")', [V]), (f'pwd = os.environ.get("DB_PASSWORD_1", default="{V}")', [V]),
    ('pwd = os.environ["DB_PASSWORD_1"]', []), ('pwd = os.getenv("DB_PASSWORD_1")', []),
    (f'pwd = process.env.DB or "{V}"', [V]), (f'pwd = new Secret("{V}")', [V]), (f"pwd=${{DB_PASSWORD:-{V}}}", [V]),
    (f'pwd = K\nK = "{V}"', [V]), (f'pwd = a + b\na = "s3cr3t"\nb = "V4lue99!"', ["s3cr3t", "V4lue99!"]),
    (f'k = "{V}"\npwd = "${{k}}"', [V]), ("a = b\nb = a\npwd = a", []), (f'a = a or "{V}"\npwd = a', [V]),
    (f'pwd = ("{V}"', [V]), ("pwd = f(((", []),
])
def test_lexed_source_syntax(text, want):
    assert [text[s:e] for s, e in secret_scan.literal_spans(text)] == want
    assert not any(w in secret_scan.redact(text) for w in want)


@pytest.mark.parametrize("unit", ["# a = b\n", "a: b<", "a = (", "x = `", 'x = """', "a: b[", "k = k + k\n", "a =\n", "x = f(1, ", "a | b: ",
                                  "token = a\n", "token = token + a\n", "token = '", "+x", "a:b ", "${a", "\\\n", "x=(a,",
                                  "a=b+", "a=$b", "token=b+", "token=aB3+", "token=$b", "a=${b}+"])
def test_lexing_is_not_quadratic(unit):
    import time
    took = []
    for n in (50_000, 400_000):                      # eight times the text
        t = time.time()
        secret_scan.literal_spans("t = " + unit * (n // len(unit)))
        took.append(time.time() - t)
    assert took[1] < 24 * took[0] + 2


def test_armoured_keys_and_pass_phrases():
    for text, want in [
            ('private_key = "-----BEGIN RSA PRIVATE KEY-----MIIEpAIBAAKCAQEA-----END RSA PRIVATE KEY-----"', True),
            ('private_key = """\n-----BEGIN PRIVATE KEY-----\nMIIEpAIBAAKC AQEA\n-----END PRIVATE KEY-----\n"""', True),
            ('password = "correct horse battery staple"', True), ('password = "please enter your password here"', False),
            ('colour = "correct horse battery staple"', False), ('password = "the name of the user"', False)]:
        assert bool(secret_scan.literal_spans(text)) is want, text
        assert ("horse" in secret_scan.redact(text)) is (("horse" in text) and not want)


def test_suffixes_of_one_bare_word_score_as_each_by_itself():
    import random
    r = random.Random(2)
    for _ in range(40):
        text = "".join(r.choice(["token=", "a=", "pwd=", "+", "b", "X9", "zQ", "aaaa", "/"]) for _ in range(30))
        got = secret_scan.literal_spans(text)
        spans = {(a, b) for a in range(len(text)) for b in (len(text),)}
        shared = secret_scan._suffix_strengths(text, spans)
        assert all(abs(v - secret_scan.strength(text[a:b])) < 1e-12 for (a, b), v in shared.items())
        assert all(secret_scan.strength(text[a:b]) >= .5 for a, b in got)


def test_literals_of_many_parts_and_long_names():
    parts = [f"k{i}Zq9" for i in range(200)]
    chain = "api_key = " + " + ".join(f'"{p}"' for p in parts)
    added = 'k = ""\n' + "\n".join(f'k = k + "{p}"' for p in parts) + "\nsecret_key = k"
    for text in (chain, added):
        assert [text[s:e] for s, e in secret_scan.literal_spans(text)] == parts
        assert not any(p in secret_scan.redact(text) for p in parts)
    name = "x" * 300
    for text in (f'password_{name} = "s3cr3tV4lue99"', f'{name} = "s3cr3tV4lue99"\nauth = {name}', "--password: 's3cr3tV4lue99'"):
        assert [text[s:e] for s, e in secret_scan.literal_spans(text)] == ["s3cr3tV4lue99"]
    grown = 'token = ""\n' + "".join(f'token = token + "{i}aZ"\n' for i in range(20_000)) + "a" * 500_000     # neither is quadratic
    assert len(secret_scan.literal_spans(grown)) == 20_000


def test_secret_scan_edges(spark):
    got = {r["doc_id"]: r for r in secret_scan.scan(docs(spark, True)).collect()}
    assert secret_scan.scan(docs(spark)).count() == len(DOCS)
    assert got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[4]["spans"] == ""
    assert got[11]["n_assign"] == 1 and got[11]["spans"] == "assign:0:28,literal:12:28"
    assert got[11]["base_sha256"] == hashlib.sha256(b"assign:0:28").hexdigest()
    red = {r["doc_id"]: r for r in secret_scan.redacted(docs(spark, True)).collect()}
    assert red[11]["text"] == '[SECRET]"' and red[4]["text"] is None and red[6]["text"] == DOCS[6][1] and red[1]["_text"] == "y"
    assert secret_scan.scan(no_docs(spark)).collect() == [] == secret_scan.redacted(no_docs(spark)).collect()


def _least_padding(lengths, counts, k):
    best = None
    for m in range(1, min(k, len(lengths)) + 1):
        for cut in itertools.combinations(lengths[:-1], m - 1):
            bounds = [*cut, lengths[-1]]
            cost = sum(c * (next(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))
            best = cost if best is None else min(best, cost)
    return best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_bucket_bounds_are_optimal(hist, k):
    lengths, counts = map(np.array, zip(*sorted(hist.items())))
    bounds = packing.bucket_bounds(lengths, counts, k)
    assert len(bounds) <= k and bounds == sorted(set(bounds)) and bounds[-1] == lengths[-1]
    cost = sum(int(c) * (next(b for b in bounds if b >= n) - int(n)) for n, c in zip(lengths, counts))
    assert cost == _least_padding(lengths.tolist(), counts.tolist(), k)


def _packed_whole(got):
    return {(r["doc_id"], r["n"]) for r in got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}


def test_packing_by_tokens(spark):
    data = [(1, "水" * 5000), (2, "The rivers."), (3, None), (4, "x9" * 3000)]      # one word each, many tokens
    d = spark.createDataFrame(data, "doc_id long, text string")
    want = {(r["doc_id"], r["n_tokens"]) for r in pieces.encode(d, PIECE_MODEL).collect()}
    counts = pieces.counted(d, PIECE_MODEL)
    assert {tuple(r) for r in counts.collect()} == want
    got = packing.pack(counts, F.col("n_tokens"))
    assert _packed_whole(got) == want and got.where("doc_id = 1").count() > 1 and got.where("n_tokens > 2048").count() == 0
    assert pieces.counted(d.limit(0), PIECE_MODEL).collect() == []
    tokens = {(r["doc_id"], r["n_tokens"]) for r in queries.op9_sentencepiece(spark, SF001).collect()}
    assert _packed_whole(queries.op6_packing(spark, SF001)) == tokens


def test_counts_equal_the_ids(spark):
    texts = ["  a  b\n\n c▁d ▁ x\ty\r\nz ", "▁▁", "\n", " ", "水火 \u0000 é", "a\nb c\n d", None, "", LONG, "x" * 5000, *_texts()]
    model = _model_bytes()
    assert pieces.Counts(model).lengths(texts) == [len(x) for x in pieces.Pieces(model).encode(texts)]


def test_windows_carry_their_ids(spark):
    whole = {r["doc_id"]: r["ids"] for r in pieces.encode(docs(spark).where("doc_id <> 2"), PIECE_MODEL).collect()}
    got = packing.pack(pieces.encode(docs(spark).where("doc_id <> 2"), PIECE_MODEL), F.col("n_tokens"), max_length=50, ids=F.col("ids"))
    parts = {}
    for r in got.orderBy("doc_id", "part").collect():
        assert len(r["ids"]) == r["n_tokens"] <= 50 and r["first_token"] == 50 * r["part"]
        parts.setdefault(r["doc_id"], []).extend(r["ids"])
    assert parts == whole


@pytest.mark.parametrize("shard_rows", [50_000, 2])
def test_packing_keeps_every_token_within_the_budget(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(packing, "SHARD_ROWS", shard_rows)
    got = packing.pack(docs(spark, True), max_length=50, buckets=3, budget=120).collect()
    want = Counter()
    for i, t, *_ in DOCS:
        n = len(WORDS.findall(t or ""))
        for p in range(max(1, -(-n // 50))):
            want[i, p, p * 50, min(50, n - p * 50)] += 1
    assert Counter((r["doc_id"], r["part"], r["first_token"], r["n_tokens"]) for r in got) == want
    assert len({r["bucket_length"] for r in got}) <= 3
    batches = {}
    for r in got:
        assert r["n_tokens"] <= r["bucket_length"]
        batches.setdefault(r["batch_id"], []).append(r)
    for rs in batches.values():
        assert len({r["bucket_length"] for r in rs}) == 1
        assert len(rs) <= max(1, 120 // rs[0]["bucket_length"])
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    assert packing.pack(no_docs(spark)).collect() == []


def _model_bytes():
    with open(PIECE_MODEL, "rb") as f:
        return f.read()


def _texts():
    r = random.Random(5)
    made = ["".join(r.choice(["the", "ing", "on", " ", "  ", "\n", "é", "漢", "<0x0A>", "▁", "X", "9", "\t", "tion"])
                    for _ in range(r.randint(0, 40))) for _ in range(300)]
    return made + ["", " ", "  a  b ", "a" * 5000, "日本語のテキスト", "The quick brown fox's internationalization!! 12345.678"]


def test_bpe_ids_equal_the_library():
    lib, mine, texts = sentencepiece.SentencePieceProcessor(model_proto=_model_bytes()), pieces.Pieces(_model_bytes()), _texts()
    assert not mine.unigram
    got = mine.encode(texts)
    assert [x.tolist() for x in got] == lib.encode(texts)
    assert [mine.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]
    assert [mine.decode(x) for x in got] == [lib.decode(x.tolist()) for x in got]
    assert [x.tolist() for x in mine.encode(texts, {})] == [x.tolist() for x in got]      # whatever the cache


def test_unigram_split_has_the_highest_score():
    """The same pieces read as a unigram model, against all splits."""
    data = _model_bytes()
    at = data.rindex(b"\x18\x02 \x80\xfa\x01")
    mine = pieces.Pieces(data[:at] + b"\x18\x01" + data[at + 2:])
    assert mine.unigram
    mine.score = [max(x, -40_000.0) for x in mine.score]     # keep sums apart in double precision

    def best(word):
        top = [0.0]
        for i in range(1, len(word) + 1):
            known = [top[j] + mine.score[mine.vocab[word[j:i]]] for j in range(i) if word[j:i] in mine.vocab]
            top.append(max(known, default=top[i - 1] + mine.unknown_score))
        return top[-1]

    for text in [t[:40] for t in _texts() if t]:
        for word in mine.words.findall(mine.normal(text)):
            ids = mine.encode_words([word])[word]
            n_bytes = sum(len(c.encode()) for c in word if c not in mine.vocab)
            unknown = sum(c not in mine.vocab for c in word)
            got = sum(mine.score[i] for i in ids if i not in mine.byte_ids.values()) + unknown * mine.unknown_score
            assert got == pytest.approx(best(word)) and sum(i in mine.byte_ids.values() for i in ids) == n_bytes


def test_pieces_edges(spark):
    got = pieces.encode(docs(spark, True), PIECE_MODEL)
    assert got.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    assert sorted(r["n_tokens"] for r in got.collect())[:3] == [0, 0, 0] and all(r["round_trip"] for r in got.collect())
    back = pieces.decode(got, PIECE_MODEL).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in back) == Counter((r[0], r[1] or "") for r in DOCS)
    assert pieces.encode(no_docs(spark), PIECE_MODEL).collect() == []
