"""The command lines on small files, from corpora to the table."""

import json
import random

from lexloom.operators import tokenize
from lexloom.plans import evaluate, pipeline
from lexloom.sources import corpora

WORDS = "the cat dog house walks walking walked sees seeing old new tree under over unhappy kindness with from and".split()


def texts(folder, rng, n=80):
    folder.mkdir()
    (folder / "childes.train").write_text("".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 12))) + ".\n" for _ in range(n)))
    (folder / "gutenberg.train").write_text("".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 12))) + f" {k % 9}.\n" for k in range(n)))


def document(spark, path):
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def test_from_corpora_to_the_table(spark, tmp_path):
    rng, at = random.Random(1), f"file://{tmp_path}"
    texts(tmp_path / "in", rng)
    (tmp_path / "pairs").mkdir()
    for s in ("npi_present_1", "wh_island"):
        rows = [{"sentence_good": "the cat walks over the house", "sentence_bad": "cat the over house walks the the"} for _ in range(4)]
        (tmp_path / "pairs" / f"{s}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    evaluate.main(["train", "--input-dir", f"{at}/in", "--output-dir", f"{at}/vocab", "--sizes", "10", "40", "--segment", "marked"])
    small, large = (corpora.read_vocab(spark, f"{at}/vocab/{n}/tokenizer.vocab") for n in (10, 40))
    several = lambda v: [r.piece for r in v.filter("kind = 'learned' AND length(piece) > 1").orderBy("id").collect()]
    assert len(several(small)) == 10 and several(large)[:10] == several(small)
    words = tokenize.vocabulary(large, "bpe")
    assert tokenize.decode(words.pieces("the walking tree")) == "the walking tree"
    evaluate.main(["tokenizer-report", "--input-dir", f"{at}/in", "--vocab", f"{at}/vocab/40", "--name", "morph_40", "--output", f"{at}/report.json"])
    assert document(spark, f"{at}/report.json")["avg_tokens_per_word"] > 1
    shared = ["--pairs-dir", f"{at}/pairs", "--corpus-dir", f"{at}/in"]
    evaluate.main(["pairs", *shared, "--output", f"{at}/results.json"])
    found = document(spark, f"{at}/results.json")
    assert set(found["subsets"]) == {"npi_present_1", "wh_island"} and found["averages"]["raw_log_prob"] == 1.0
    evaluate.main(["sweep", *shared, "--vocab", f"{at}/vocab/40", "--sizes", "0", "10", "40", "--output", f"{at}/sweep.json"])
    assert [r["vocab_size"] for r in document(spark, f"{at}/sweep.json")] == [0, 10, 40]
    evaluate.main(["imbalance", *shared, "--output", f"{at}/imbalance"])
    assert {r["metric"]: r["p"] for r in document(spark, f"{at}/imbalance/correlations")["overall"]}["bpb"] == 1.0
    assert spark.read.json(f"{at}/imbalance/pairs").count() == 8
    evaluate.main(["table", "--model", f"Baseline={at}/results.json", "--model", f"Morph-40={at}/results.json", "--tokenizer", f"{at}/report.json", "--output", f"{at}/table.md"])
    lines = [r.line for r in corpora.read_lines(spark, f"{at}/table.md").orderBy("pos").collect()]
    assert len(lines) == 4 and lines[2].startswith("| Baseline | - | - | - | 1.0000") and "%" in lines[3]


def test_pipeline_writes_the_last_phase_in_order(spark, tmp_path):
    rng, at = random.Random(2), f"file://{tmp_path}"
    texts(tmp_path / "in", rng, 200)
    pipeline.main(["--input-dir", f"{at}/in", "--output-dir", f"{at}/out", "--target-tokens", "5000", "--sample-tokens", "1500"])
    import hashlib

    last = [r.line for r in corpora.read_lines(spark, f"{at}/out/clean_1M").orderBy("doc_id", "pos").collect()]
    keys = [hashlib.md5(f"42|{line}".encode()).hexdigest() for line in last]
    assert len(last) > 20 and keys == sorted(keys)
    manifest = document(spark, f"{at}/out/clean_1M_manifest")
    assert sum(m["lines"] for m in manifest) == len(last)
    assert document(spark, f"{at}/out/cleaning_report")["summary"]["input_lines"] == 400
