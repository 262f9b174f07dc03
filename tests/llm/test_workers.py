"""Operators run where the workers cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPOSITORY = Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
repository, shared, vocabulary = sys.argv[1:]
sys.path.insert(0, repository)  # the driver's path, which workers do not get
from pyspark.sql import SparkSession, functions as F
from tallyflow.llm import collocations, decontamination, fingerprints, language_model, order_minhash, repair, secrets, token_counts, toxicity

spark = (
    SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", shared).getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")

def visible(batches):
    import importlib.util
    for batch in batches:
        yield batch.set_column(0, "id", __import__("pyarrow").array([int(importlib.util.find_spec("tallyflow") is not None)] * len(batch)))

assert spark.range(4).mapInArrow(visible, "id long").agg(F.sum("id")).first()[0] == 0, "workers can import the package"

text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.concat(F.lit("w"), (F.col("id") * i % 17).cast("string"))))
docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(text, F.when(F.col("id") % 3 == 0, " vile vilely").otherwise(" calm")).alias("text"))
docs = docs.withColumn("lang", F.lit("en"))
labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
bench = docs.filter("doc_id < 5").select(F.col("doc_id").cast("string").alias("item_id"), "text")

model = toxicity.train(docs, labels)
assert toxicity.score(docs, model).filter("predicted = 1").count() == 100
assert toxicity.drop_toxic(docs, model).count() == 200
for words in (8_000_000, 10):
    assert decontamination.contamination(docs, bench, block_words=words).filter("contaminated").count() >= 5
    assert decontamination.decontaminate(docs, bench, block_words=words).count() <= 295
print("toxicity, decontamination", flush=True)
fitted = language_model.fit(docs)
assert language_model.score(docs, *fitted).filter("score < 0").count() == 300
print("language model", flush=True)
if vocabulary:
    assert token_counts.token_counts(docs, vocabulary).filter("n_tokens > 0").count() == 300
order_minhash.near_duplicates(docs).count()
fingerprints.edited_fingerprints(docs).count()
secrets.secret_scan(docs).count()
collocations.collocations(docs).count()
turns = docs.select(F.floor(F.col("doc_id") / 4).cast("string").alias("conv_id"), (F.col("doc_id") % 4).cast("int").alias("turn"), F.lit("user").alias("role"), "text")
repair.damage_and_repair(turns).count()
print("done", flush=True)
"""


def test_workers_need_no_package(tmp_path):
    try:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        vocabulary = ""
    environment = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    for entry in filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        if Path(entry).resolve() != REPOSITORY:
            environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), entry]))
    script = tmp_path / "driver.py"
    script.write_text(SCRIPT)
    run = subprocess.run(
        [sys.executable, str(script), str(REPOSITORY), str(tmp_path / "shared"), str(vocabulary)],
        cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600, check=False,
    )
    if "workers can import the package" in run.stderr:
        pytest.skip("the package is installed for all")
    assert run.returncode == 0 and run.stdout.endswith("done\n"), run.stdout + run.stderr[-3000:]
