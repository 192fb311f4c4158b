"""Names and types of the registered results, and a plain FTRL loop beside the library's."""

import numpy as np
import pytest

from webtables.llm import toxicity

SMALL = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op5_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_nearest": "query_id bigint, rank int, vec_id bigint, score double",
    "op7_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op8_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op11_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op12_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op13_simhash": "doc_id bigint, fingerprint string, component_id bigint",
}


@pytest.mark.parametrize("name", list(CONTRACTS))
def test_names_and_types(spark, name):
    import __spark_entry__ as entry

    kinds = dict(entry.queries()[name](spark, SMALL).dtypes)
    assert {k: kinds.get(k) for k in (c.split(" ")[0] for c in CONTRACTS[name].split(", "))} == dict(c.split(" ") for c in CONTRACTS[name].split(", "))


def plain_ftrl(rows, labels, alpha=0.5, beta=1.0, l1=8.0, l2=0.1, epochs=toxicity.EPOCHS, seed=7):
    """FTRL-proximal as published: one coordinate at a time, in dictionaries."""
    often = {}
    for f in rows:
        for i in f.tolist():
            often[i] = often.get(i, 0) + 1
    z, n = {}, {}

    def weight(i):
        if i == "bias":  # no L1 and no L2 on the bias
            return -z.get(i, 0.0) * alpha / (beta + n.get(i, 0.0) ** 0.5)
        zi = z.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - (l1 if zi > 0 else -l1)) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            x = [i for i in rows[k].tolist() if often[i] >= toxicity.LEAST_ROWS] + ["bias"]
            w = {i: weight(i) for i in x}
            g = 1 / (1 + np.exp(-min(max(sum(w.values()), -35), 35))) - labels[k]
            for i in x:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return weight("bias"), {i: weight(i) for i in z if i != "bias" and weight(i)}


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 300, 25)).astype(np.int32) for _ in range(400)]
    labels = np.array([float(any(i in (7, 11) for i in f.tolist())) for f in rows])
    model = toxicity.fit_ftrl(rows, labels, bits=10)
    bias, weights = plain_ftrl(rows, labels)
    assert abs(model.bias - bias) < 1e-6 and set(model.features.tolist()) == set(weights) and len(weights) > 1
    assert np.allclose(model.weights, [weights[i] for i in model.features.tolist()], rtol=1e-5)
