import re
import random

import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import labels as L
from textloom.operators import splits, stats
from textloom.operators.tokens import gazetteer_labels, overlap_labels, token_rows
from textloom.plans import corpus
from textloom.sinks import writers
from textloom.sources import annotated as A
from textloom.sources import records as R


def rows(df):
    return sorted((r.lang, tuple(r.tokens), tuple(r.labels)) for r in df.collect())


def test_conll(spark, tmp_path):
    (tmp_path / "set.sr.conll").write_text("1\tAna\t\t\t\t\t\t\t\t\tB-per\n# c\n\n\n1\tgre\t\t\t\t\t\t\t\t\tO\n2\tx\n3", encoding="utf-8")
    assert rows(corpus.setimes(spark, str(tmp_path))) == [("sr", ("Ana",), ("B-PER",)), ("sr", ("gre", "x"), ("O", "O"))]
    (tmp_path / "train.conll").write_text("a\tO\nb\tO\n", encoding="utf-8")
    (tmp_path / "dtest.conll").write_text("a\tx\tB-P\nb\tI-T\n", encoding="utf-8")
    assert rows(corpus.cnec(spark, str(tmp_path))) == [("cs", ("a", "b"), ("B-PER", "O"))]


def test_conll_against_brute_force(spark, tmp_path):
    rnd, want = random.Random(5), []
    for n in range(12):
        ls = [rnd.choice(["1\tw%d\tB-X" % rnd.randint(0, 9), "1\tv\tO", "", "  ", "# note", "short"]) for _ in range(rnd.randint(0, 25))]
        (tmp_path / f"f{n}.conll").write_text("\n".join(ls), encoding="utf-8")
        sents, cur = [], []
        for x in [*ls, ""]:
            if not x.strip():
                sents += [cur] if cur else []
                cur = []
            elif not x.startswith("#") and len(p := x.split("\t")) > 1:
                cur.append((p[1], p[-1]))
        if any(b != "O" for s in sents for _, b in s):
            want += [(f"f{n}.conll", tuple(a for a, _ in s), tuple(b for _, b in s)) for s in sents]
    got = A.conll(A.whole_files(spark, str(tmp_path), "*.conll"), 1, A.last_column)
    assert sorted((r.file, tuple(r.tokens), tuple(r.labels)) for r in got.collect()) == sorted(want)


def test_suk_and_wann(spark, tmp_path):
    suk = tmp_path / "suk"
    suk.mkdir()
    cell = "1\tAna" + "\t_" * 7 + "\t"
    (suk / "a.ud.conllu").write_text(cell + "SpaceAfter=No|NER=B-deriv-per\n" + cell + "_\n", encoding="utf-8")
    (suk / "ambiga.ud.conllu").write_text(cell + "NER=B-per\n", encoding="utf-8")
    assert rows(corpus.suk(spark, str(suk))) == [("sl", ("Ana", "Ana"), ("B-PER", "O"))]
    (tmp_path / "w" / "bs-wann").mkdir(parents=True)
    (tmp_path / "w" / "bs-wann" / "train").write_text("bs:Sarajevo B-LOC\nbs:je O\n\nbs:a:b O\n", encoding="utf-8")
    assert rows(corpus.wann(spark, str(tmp_path / "w"), {"bs-wann": "bs"})) == [("bs", ("Sarajevo", "je"), ("B-LOC", "O")), ("bs", ("a:b",), ("O",))]


def test_bsnlp(spark, tmp_path):
    for kind in ("raw", "annotated"):
        (tmp_path / kind / "t" / "sl").mkdir(parents=True)
    (tmp_path / "raw/t/sl/1.txt").write_text("d1\nsl\n2020\nurl\nNew York je velik. Ana x@y\n", encoding="utf-8")
    (tmp_path / "raw/t/sl/2.txt").write_text("d2\nsl\n2020\nurl\nBrez oznak\n", encoding="utf-8")
    (tmp_path / "annotated/t/sl/1.out").write_text("d1\nnew york\tn\tloc\nx@y\tx\tPRO\nAna\ta\tper\nbad\n", encoding="utf-8")
    assert rows(corpus.bsnlp(spark, str(tmp_path))) == [("sl", ("Ana", "x@y"), ("B-PER", "O")), ("sl", ("New", "York", "je", "velik", "."), ("B-LOC", "I-LOC", "O", "O", "O"))]


def test_standoff(spark, tmp_path):
    d = tmp_path / "v2.0/data/bruk"
    d.mkdir(parents=True)
    (tmp_path / "v2.0/data/ng").mkdir()
    (d / "a.txt").write_text("Ivan Franko\n\nu Lvivi 5 dniv", encoding="utf-8")
    (d / "a.ann").write_text("T1\tPERS 0 11\tIvan Franko\nT2\tLOC\t15\t20\tLvivi\nT3\tDATE 21 27\t5 dniv\nT4\tPERS x y\tz", encoding="utf-8")
    (d / "b.txt").write_text("no annotations", encoding="utf-8")
    assert rows(corpus.ner_uk(spark, str(tmp_path))) == [("uk", ("Ivan", "Franko"), ("B-PER", "B-PER")), ("uk", ("u", "Lvivi", "5", "dniv"), ("O", "B-LOC", "O", "O"))]
    assert rows(corpus.ner_uk(spark, str(tmp_path), bio=True))[0][2] == ("B-PER", "I-PER")
    both = corpus.prepare(spark, {"ner-uk": str(tmp_path)})
    assert [r.lang for r in corpus.missing_langs(both, ["uk", "sl"]).collect()] == ["sl"]
    assert corpus.training_rows(both, ["sl", "uk"]).count() == 2


def test_gazetteer_against_brute_force(spark):
    rnd, data = random.Random(3), []
    for i in range(150):
        toks = [rnd.choice(["a", "B", "c", "d@"]) for _ in range(rnd.randint(0, 8))]
        ents = [([rnd.choice(["a", "b", "C"]) for _ in range(rnd.randint(1, 3))], "B-X", "I-X") for _ in range(rnd.randint(0, 3))]
        data.append((i, toks, ents))
    df = spark.createDataFrame(data, "id int, toks array<string>, ents array<struct<t:array<string>,b:string,i:string>>")
    got = {r.id: r.l for r in df.select("id", gazetteer_labels("toks", "ents").alias("l")).collect()}
    for i, toks, ents in data:
        lab = ["O"] * len(toks)
        for t, b, inner in ents:
            p, k = [x.lower() for x in t], 0
            while k <= len(toks) - len(p):
                if [x.lower() for x in toks[k : k + len(p)]] == p and all(x == "O" for x in lab[k : k + len(p)]):
                    for j in range(len(p)):
                        lab[k + j] = "O" if "@" in toks[k + j] else (b if j == 0 else inner)
                    k += len(p)
                else:
                    k += 1
        assert got[i] == lab


def test_overlap_half_open(spark):
    docs = spark.createDataFrame([(1, "abcd efghi"), (2, "no spans here"), (3, ""), (4, None)], "d int, t string")
    spans = spark.createDataFrame([(1, 0, 10, 12, "Y"), (1, 1, 9, 12, "X")], "d int, ord int, start int, end int, label string")
    assert [(r.d, r.token, r.label) for r in overlap_labels(docs, spans, ["d"], "t").orderBy("d", "pos").collect()] == [(1, "abcd", "O"), (1, "efghi", "B-X"), (2, "no", "O"), (2, "spans", "O"), (2, "here", "O")]
    t = spark.createDataFrame([(1, "  aš 🦄b\n\nc ")], "d int, t string")
    assert [(r.token, r.start, r.end) for r in token_rows(t, ["d"], "t").orderBy("pos").collect()] == [("aš", 2, 4), ("🦄b", 5, 7), ("c", 9, 10)]


@pytest.mark.parametrize("bio", [False, True])
def test_overlap_against_brute_force(spark, bio):
    rnd = random.Random(6)
    texts = {i: "".join(rnd.choice(["a", "bc ", " ", "\n", "déf", "🦄 "]) for _ in range(rnd.choice([0, 1, 5, 60, 700]))) for i in range(25)}
    spans = {i: [(o, s, s + rnd.randint(0, 9), rnd.choice(["PERS", "DATE", "LOC"])) for o, s in enumerate(rnd.randint(0, max(1, len(t))) for _ in range(rnd.choice([0, 3, 80])))] for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "d int, t string")
    rows = [(d, *x) for d, xs in spans.items() for x in xs]
    got = overlap_labels(docs, spark.createDataFrame(rows, "d int, ord int, start int, end int, label string"), ["d"], "t", {"PERS": "PER", "DATE": "O"}, bio).collect()
    want = []
    for d, t in texts.items():
        before = None
        for pos, m in enumerate(re.finditer(r"\S+", t)):
            hit = next((x for x in sorted(spans[d], key=lambda x: (x[1], x[0])) if m.start() < x[2] and m.end() > x[1]), None)
            kind = {"PERS": "PER", "DATE": "O", "LOC": "LOC"}[hit[3]] if hit else "O"
            label = "O" if kind == "O" else ("I-" if bio and hit == before else "B-") + kind
            want.append((d, pos, m.group(), m.start(), m.end(), label))
            before = hit
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_first_seen_order_and_counters(spark):
    from textloom.operators import encoders, stats

    df = spark.createDataFrame([(2, ["b", "a"]), (1, ["c", "b"]), (3, [None, "d"])], "k int, l array<string>")
    assert [tuple(r) for r in encoders.first_seen(df, "l", ["k"]).orderBy("id").collect()] == [("c", 0), ("b", 1), ("a", 2), ("d", 3)]
    files = spark.createDataFrame([("t1", "a"), ("t1", "a"), ("t1", "b"), ("t2", "c")], "topic string, file string")
    assert sorted(((r.topic or "", r.files, r.rows) for r in stats.counters(files, ["topic"]).collect())) == [("", 3, 4), ("t1", 2, 3), ("t2", 1, 1)]


def test_training_splits(spark):
    from textloom.plans import corpus

    df = spark.createDataFrame([("de", "train"), ("en", "train"), ("en", "eval")], "lang string, split string")
    got = corpus.training_splits(df, ["en", "de"])
    assert [r.lang for r in got["train"].collect()] == ["en", "de"] and got["eval"].count() == 1
    with pytest.raises(ValueError, match="eval"):
        corpus.training_splits(df, ["de"])


def test_labels(spark):
    df = spark.createDataFrame([("NER=B-per|SpaceAfter=No",), ("o",), (" O ",), ("B-xyz",)], "l string")
    assert [r[0] for r in df.select(L.remap(L.normalize(F.col("l")), {"B-per": "B-PER"})).collect()] == ["B-PER", "O", "O", "B-xyz"]
    ids = F.create_map(F.lit("O"), F.lit(0), F.lit("B-PER"), F.lit(1))
    one = spark.createDataFrame([([None, 0, 0, 1, None], ["B-PER", "O"])], "w array<int>, l array<string>")
    assert one.select(L.align_subwords(F.col("w"), F.col("l"), ids)).first()[0] == [-100, 1, 1, 0, -100]


@pytest.mark.parametrize(("n", "ratios", "want"), [(10, (0.8, 0.1, 0.1), (8, 1, 1)), (7, (0.8, 0.1, 0.1), (5, 0, 2)), (10, (0, 0, 0), (8, 1, 1))])
def test_split_sizes(spark, n, ratios, want):
    df = spark.createDataFrame([(i, "sl") for i in range(n)], "id int, lang string")
    got = {r.split: r["count"] for r in splits.stratified_split(df, "lang", "id", ratios).groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in splits.SPLITS) == want


def test_stats_and_tables(spark):
    df = spark.createDataFrame([("sl", ["a"], ["B-PER"]), ("sl", ["a"], ["B-PER"]), ("hr", ["b"], ["O"])], "lang string, tokens array<string>, labels array<string>")
    s = stats.label_stats(df, ["lang"]).orderBy("lang")
    assert [tuple(r) for r in s.collect()] == [("hr", 1, 1, 0), ("sl", 2, 2, 2)]
    assert len(stats.text_table(s)) == 3
    assert corpus.split(df).count() == 3


def test_sinks_round_trip(spark, tmp_path):
    df = spark.range(25).selectExpr("id", "array('a', 'b') as xs")
    writers.write_articles(df, str(tmp_path / "o"), 10, ["id"])
    files = {p.parent.name: sorted(json.loads(x)["id"] for x in p.read_text().splitlines()) for p in (tmp_path / "o/jsonl").glob("*/*.json")}
    assert files == {"shard=0": list(range(10)), "shard=1": list(range(10, 20)), "shard=2": list(range(20, 25))}
    assert spark.read.csv(str(tmp_path / "o/csv"), header=True).count() == 25
    writers.write_articles(df, str(tmp_path / "loose"), 10)
    assert spark.read.json(str(tmp_path / "loose/jsonl")).count() == 25
    writers.write_articles(df.limit(0), str(tmp_path / "none"), 10)
    assert not (tmp_path / "none").exists()
    sent = spark.createDataFrame([("sl", "train", ["a", "b"], ["O", "O"])], "lang string, split string, tokens array<string>, labels array<string>")
    writers.write_sentences(sent, str(tmp_path / "p"))
    back = R.prepared_sentences(spark, str(tmp_path / "p"))
    assert [tuple(r) for r in back.collect()] == [("sl", "train", ["a", "b"], ["O", "O"])]
    with pytest.raises(R.MergeError):
        writers.write_json_lines(spark.range(0), str(tmp_path / "q"))
    assert writers.dump_metrics([{"f1": 0.5}], "m", tmp_path, {"k": 1}, 100).read_text().count("50.0") == 1


def test_json_records(spark, tmp_path):
    for s in ("dev", "test", "train"):
        (tmp_path / "dataset" / s).mkdir(parents=True)
    (tmp_path / "dataset/dev/a.JSON").write_text('[{"a":1},{"a":2}]')
    (tmp_path / "dataset/test/b.json").write_text('{"a":3}')
    with pytest.raises(R.MergeError):
        R.merged_splits(spark, str(tmp_path)).count()
    (tmp_path / "dataset/train/c.json").write_text("5")
    got = R.merged_splits(spark, str(tmp_path)).select("split", "pos", F.to_json("record").alias("r")).collect()
    assert sorted(tuple(x) for x in got) == [("dev", 0, '{"a":1}'), ("dev", 1, '{"a":2}'), ("test", 0, '{"a":3}'), ("train", 0, "5")]


def test_archives(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.txt", "hi")
    assert [(r.member, bytes(r.content)) for r in R.zip_members(spark, str(tmp_path)).collect()] == [("d/x.txt", b"hi")]
    assert (R.extract_zip(tmp_path / "a.zip", tmp_path / "out") / "d/x.txt").read_text() == "hi"
    with pytest.raises(ValueError, match="leaves"):
        R.safe_member(tmp_path / "out", "../outer/x")
    (tmp_path / "src.bin").write_bytes(b"x" * 10)
    assert R.download([(tmp_path / "src.bin").as_uri()], tmp_path / "dl")[0].read_bytes() == b"x" * 10


def aes_zip(path, members, password, strength, method=8, damage=False):
    """An archive encrypted as AE-2, written by hand."""
    import hmac
    import os
    import struct
    import zlib

    from textloom.sources import aes_zip as Z

    size, out, central = Z.KEY_BYTES[strength], b"", b""
    for name, content in members.items():
        packed = zlib.compressobj(9, 8, -15)
        plain = packed.compress(content) + packed.flush() if method == 8 else content
        salt = os.urandom(size // 2)
        key, code_key, check = Z.derive(password, salt, size)
        body = Z.counter_mode(plain, key)
        code = hmac.new(code_key, body, "sha1").digest()[:10]
        data = salt + check + (body[:-1] + bytes([body[-1] ^ 1]) if damage else body) + code
        extra = struct.pack("<HHH2sBH", 0x9901, 7, 2, b"AE", strength, method)
        fields = struct.pack("<HHHHHIIIHH", 51, 1, 99, 0, 0, 0, len(data), len(content), len(name), len(extra))
        central += b"PK\x01\x02" + struct.pack("<H", 51) + fields + struct.pack("<HHHII", 0, 0, 0, 0, len(out)) + name.encode() + extra
        out += b"PK\x03\x04" + fields + name.encode() + extra + data
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(members), len(members), len(central), len(out), 0)
    path.write_bytes(out + central + end)


def test_aes_cipher():
    """The examples of the cipher's standard for three key lengths."""
    import numpy as np

    from textloom.sources import aes_zip as Z

    plain = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), dtype=np.uint8).reshape(1, 16)
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        assert Z.encrypt_blocks(plain, Z.round_keys(bytes(range(n)))).tobytes().hex() == want


@pytest.mark.parametrize("strength", [1, 2, 3])
def test_encrypted_archives(spark, tmp_path, strength):
    from textloom.sources import aes_zip as Z

    members = {"a/b.txt": "čšž ".encode() * 5000, "c.txt": b"", "d.bin": bytes(range(256)) * 9000}
    aes_zip(tmp_path / "x.zip", members, b"secret", strength, 8 if strength > 1 else 0)
    out = R.extract_zip(tmp_path / "x.zip", tmp_path / "out", "secret")
    assert {n: (out / n).read_bytes() for n in members} == members
    assert {r.member: bytes(r.content) for r in R.zip_members(spark, str(tmp_path), "secret").collect()} == members
    for password in ("wrong", None):
        with pytest.raises(Z.ZipError):
            R.extract_zip(tmp_path / "x.zip", tmp_path / "no", password)
    aes_zip(tmp_path / "x.zip", {"a": b"abc"}, b"secret", strength, damage=True)
    with pytest.raises(Z.ZipError, match="code"):
        R.extract_zip(tmp_path / "x.zip", tmp_path / "no", "secret")
    aes_zip(tmp_path / "y.zip", {"../up.txt": b"abc"}, b"secret", strength)
    with pytest.raises(ValueError, match="leaves"):
        R.extract_zip(tmp_path / "y.zip", tmp_path / "no", "secret")


def test_missing_splits_are_named(spark, tmp_path):
    (tmp_path / "dataset/dev").mkdir(parents=True)
    with pytest.raises(R.MergeError, match="test, train"):
        R.merged_splits(spark, str(tmp_path))


def test_own_parser_and_metrics_hook(spark):
    from textloom.operators import sequence
    from textloom.plans import corpus

    @corpus.parser("mine")
    def read(spark, root):
        return spark.createDataFrame([("xx", [root], ["O"])], "lang string, tokens array<string>, labels array<string>")

    try:
        assert [tuple(r) for r in corpus.prepare(spark, {"mine": "here"}).collect()] == [("xx", ["here"], ["O"])]
    finally:
        del corpus.PARSERS["mine"]
    with pytest.raises(LookupError, match="mine"):
        corpus.prepare(spark, {"mine": "here"})
    df = spark.createDataFrame([([[0.1, 0.9], [0.8, 0.2]], [1, 0])], "z array<array<double>>, ids array<int>")
    assert sequence.compute_metrics(df, "z", "ids", {0: "O", 1: "B-X"}) == {"precision": 1.0, "recall": 1.0, "f1": 1.0, "accuracy": 1.0}
