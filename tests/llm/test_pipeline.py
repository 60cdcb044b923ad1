import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
pytest.importorskip("corpus_pipeline")
import corpus_pipeline as C  # noqa: E402

from lakewright.llm import decontaminate, minhash, pii, toxicity  # noqa: E402


def test_each_stage_on_its_own_input(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != C.STAGES[-1][0]:
            assert docs.columns == list(C.COLUMNS) and docs.schema["n_chars"].dataType == before.schema["n_chars"].dataType
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    before, after = seen["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    low = {r["doc_id"] for r in toxicity.score(before, model).filter(f"score < {toxicity.THRESHOLD}").collect()}
    assert ids(after) == low
    before, after = seen["minhash_near_dedup"]
    rows = {r["doc_id"]: set(minhash.shingles(r["text"]).tolist()) for r in before.collect()}
    kept = ids(after)
    for a in rows:
        near = [b for b in rows if rows[a] and rows[b] and 100 * len(rows[a] & rows[b]) >= 80 * len(rows[a] | rows[b])]
        if len(near) <= 1:
            assert a in kept
        elif a == min(near):
            assert sum(b in kept for b in near) >= 1
        assert not (a in kept and any(b in kept and b != a for b in near))
    before, after = seen["benchmark_decontamination"]
    leaked = {r["doc_id"] for r in decontaminate.leaks(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert ids(after) == ids(before) - leaked
    before, after = seen["pii"]
    old, new = ({r["doc_id"]: r for r in df.collect()} for df in (before, after))
    assert set(old) == set(new)
    clean = {r["doc_id"] for r in before.filter(~pii.has_mention(before["text"])).collect()}
    assert clean and all((old[i] == new[i]) == (i in clean) for i in old)
    before, after = seen["mixing"]
    assert ids(after) == ids(before) and {"size", "source_size", "target", "taken"} <= set(after.columns)


def test_run_on_the_tables(spark, sf_dir):
    assert C.run(spark, sf_dir).count() > 0 and C.ORACLE_SQL is None


def test_rest_imports_without_the_optional_parts(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[:2] == ['lakewright', 'llm'] or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert 'dense_topk' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_registers_all_eleven():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(e.oracle_sql()) <= set(names)
