import json
import random

import pyarrow as pa
import pytest
import test_linededup
import test_minhash
import test_mixing

import corpus_pipeline as CP
from tidewater.llm import bpe as B
from tidewater.llm import mixing as M
from tidewater.llm import quality as Q

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(B.VOCABULARY), reason="no vocabulary here")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(seed=0, n=160):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8)))
    line = lambda: " ".join(word() for _ in range(rnd.randint(6, 14))).capitalize() + "."
    shared, out = [line() for _ in range(4)], []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.2:
            text = "\n".join("#$% !!! ### " * rnd.randint(2, 5) for _ in range(rnd.randint(1, 5)))
        elif kind < 0.35 and out:
            source = rnd.choice(out)[1] or ""
            text = " ".join(w if rnd.random() > 0.02 else word() for w in source.split(" "))
        else:
            lines = [line() for _ in range(rnd.randint(2, 8))]
            if rnd.random() < 0.4:
                at = rnd.randint(0, len(lines))
                lines[at:at] = shared
            text = "\n".join(lines)
        out.append((i, text, "en", rnd.choice(["a", "a", "a", "b", "c"]), len(text)))
    return [*out, (500, None, None, "a", None), (501, "", "en", None, 0), (502, " \n", "en", "b", 2), (503, out[3][1], "en", None, len(out[3][1])), (504, "Only one line here.", None, None, None)]


def test_stages_equal_plain_versions(spark, tmp_path):
    docs = rows()
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(not t.startswith("#")), 0) for i, t, *_ in docs[:120]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, out = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = Q.train(out, spark.read.parquet(str(tmp_path / "labels.parquet")))
    shares = Q.decode(pa.array([t for _, t, *_ in docs], pa.string()), model).field("content_share").to_pylist()
    plain = [r for r, s in zip(docs, shares) if s is not None and s >= Q.MIN_SHARE]
    stages = []
    for k, (_, stage) in enumerate(CP.STAGES):
        out = stage(spark, out, d)
        out.write.parquet(str(tmp_path / f"stage{k}"))
        out = spark.read.parquet(str(tmp_path / f"stage{k}"))
        stages.append(out)
        assert k == 4 or out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert sorted(tuple(r) for r in stages[0].collect()) == sorted(plain) and 60 < len(plain) < len(docs) - 3
    # lines: the brute-force version orders copies by id alone, and ids are distinct here
    text = {i: t for i, t, *_ in test_linededup.brute([(r[0], r[1]) for r in plain], 2)}
    after = [(i, text[i], a, s, n if text[i] == t else len(text[i])) for i, t, a, s, n in plain if i in text]
    assert sorted(tuple(r) for r in stages[1].collect()) == sorted(after) and after != plain
    stay = set(test_minhash.kept([(r[0], r[1]) for r in after]))
    single = [r for r in after if (r[0], r[1]) in stay]
    assert sorted(tuple(r) for r in stages[2].collect()) == sorted(single) and len(single) < len(after)
    drawn = test_mixing.reference(stages[2], block_rows=M.BLOCK_ROWS, shard_rows=M.SHARD_ROWS)
    mixed = [r for r in single if (r[0], r[3]) in drawn]
    assert sorted(map(repr, (tuple(r) for r in stages[3].collect()))) == sorted(map(repr, mixed))
    tokens = {r.doc_id: (list(r.tokens), r.intact) for r in stages[4].collect()}
    assert tokens == {r[0]: (B.encoding().encode_ordinary(r[1]), True) for r in mixed}
    whole = {r.doc_id: list(r.tokens) for r in CP.run(spark, d).collect()}
    assert whole == {i: t for i, (t, _) in tokens.items()}


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    wide = SCHEMA + ", tokens string, lines string, shard string, id string, sig string, key string"
    odd = [(1, None, None, None, None), (None, "A line.\nAnother line.", None, None, None), (2, "", "x", "y", 0), (3, "word " * 100_000, None, "y", None), (3, "word " * 100_000, None, "y", None)]
    for n, data in enumerate(([], [(*r, "t", "l", "s", "i", "g", "k") for r in odd])):
        df = spark.createDataFrame(data, wide)
        for k, (name, stage) in enumerate(CP.STAGES):
            df = stage(spark, df, str(tmp_path))
            df.write.parquet(str(tmp_path / f"{n}-{k}"))
            df = spark.read.parquet(str(tmp_path / f"{n}-{k}"))
            assert (df.count() == 0) == (n == 0), name
            assert k == 4 or df.columns == [x.split()[0] for x in wide.split(", ")]


def test_entry_without_the_package(tmp_path):
    """The entry module imports, and registers the engine's queries, where the package and the pipeline are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(CP.__file__))
    shutil.copytree(f"{root}/tidewater", tmp_path / "tidewater", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = json.loads(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.splitlines()[-1])
    assert "t1_topk" in got[0] and not any(n.startswith("op") or n == "pipeline" for n in got[0])
