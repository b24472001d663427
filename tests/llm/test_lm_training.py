"""With its production parameters the language model trains on every position."""

import numpy as np
import pyarrow as pa

from paddock.llm import common, lmscore


def test_every_word_trains_in_each_round(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    total = sum(len((r.text or "").encode().split()) for r in docs.collect())
    vocabulary, seen = lmscore.vocabulary_of(docs), []
    flat = lmscore.train(docs, vocabulary, seen=seen)
    assert seen == [total, total]
    trained, start = lmscore.Network(flat), lmscore.Network.start(vocabulary.log_class)
    start.parts[2][:] = 0
    gain = []
    for r in docs.toArrow().to_batches():
        found, cuts = lmscore.buckets(r)
        classes = vocabulary.class_of[found]
        near = lmscore.windows(classes, cuts)
        gain.append((trained.log_probability(near, classes) - start.log_probability(near, classes)).sum())
    assert sum(gain) > 0


def test_scores_against_plain_sums():
    """The summed log-probabilities, recomputed word by word from the network's tables."""
    texts = ["one two three two one", "Solo", "", None, "a b c d e f g a b c"]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    found, cuts = lmscore.buckets(part)
    vocabulary = lmscore.Vocabulary(np.bincount(found, minlength=lmscore.BUCKETS))
    net = lmscore.Network.start(vocabulary.log_class)
    net.learn(lmscore.training_rows(part, vocabulary, 1), np.zeros_like(net.flat))

    class Model:
        value = vocabulary, net.flat

    (got,) = lmscore.score_batches(Model)(iter([part]))
    table, bias, out, out_bias = net.parts
    for k, text in enumerate(texts):
        c = vocabulary.class_of[found[cuts[k] : cuts[k + 1]]].tolist()
        total = 0.0
        for i, own in enumerate(c):
            h = bias.astype(float).copy()
            for place, d in enumerate((-2, -1, 1, 2)):
                h += table[(c[i + d] if 0 <= i + d < len(c) else lmscore.PAD) + place * (lmscore.CLASSES + 1)]
            logits = np.tanh(h) @ out + out_bias
            total += logits[own] - np.log(np.exp(logits).sum()) + vocabulary.log_within[found[cuts[k] + i]]
        assert got.column("n_words")[k].as_py() == len((text or "").split())
        assert abs(got.column("log_likelihood")[k].as_py() - total) < 1e-3


def test_reruns_agree(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    score = lambda: {r.doc_id: r.log_likelihood for r in lmscore.pseudo_likelihood(docs, rounds=1, workers=3).collect()}
    assert score() == score()
