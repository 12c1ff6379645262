from collections import Counter

import corpus_pipeline
import public_tokenizers
import sentencepiece
from test_dedup import exact_by_force, groups_by_force
from test_models import targets

from tidewater.llm import pieces


def rows(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stages_by_force(spark, sf, tmp_path):
    """Each stage on what the one before has kept, against brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [rows(docs)]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert i == 4 or docs.columns == columns
        seen.append(rows(docs) if i < 4 else docs.collect())
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {i for i, *_ in seen[1]}
    told = [(i in kept) == (good[i] > 0) for i, *_ in seen[0] if i in good]
    assert sum(told) / len(told) > 0.9 and set(seen[1]) <= set(seen[0])
    assert Counter(i for i, *_ in seen[2]) == Counter(i for i, _, _, stays, _ in exact_by_force(seen[1]) if stays)
    assert Counter(i for i, *_ in seen[3]) == Counter({c for _, _, c in groups_by_force(seen[2])})
    sizes, took = Counter(), Counter()
    for _, t, s in seen[3]:
        sizes[s] += len(t.encode().split())
    for _, t, s in seen[4]:
        took[s] += len(t.encode().split())
    assert all(abs(took[s] - x) <= 1 for s, x in targets(sizes).items())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in seen[5]) == sorted((i, len(library.encode(t)) + 2) for i, t, _ in seen[4])
