"""Block factorisation against dense matrices, and what preprocessing refuses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import swivel
from lodestone.session import stored


def dense(cells, n, order):
    at = {t: i for i, t in enumerate(order)}
    x = np.zeros((n, n))
    for r, c, w in cells:
        x[at[r], at[c]] = w
    return x


def gradients(x, r, c, rb, cb, total, mask):
    """(row gradient, column gradient, l2, zeros) of the cells under ``mask``, written out."""
    error = r @ c.T + rb[:, None] + cb[None] - total
    full = x > 0
    error = np.where(full, error - np.log(np.where(full, x, 1)), error)
    confidence = 0.1 + 0.25 * np.sqrt(x)
    slope = np.where(full, confidence * error, 1 / (1 + np.exp(-error))) * mask / 4096
    l2 = (0.5 * confidence * error**2 * full * mask).sum() / 4096
    zeros = (np.log1p(np.exp(error)) * ~full * mask).sum() / 4096
    return slope @ c, slope.T @ r, l2, zeros


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(0)
    words = [f"w{i:02}" for i in range(23)]
    found = {(words[a], words[b]): int(rng.integers(1, 50)) for a, b in rng.integers(0, 20, (90, 2)) if a % 4 or b % 3}
    return words, [(a, b, w) for (a, b), w in found.items()]  # the last words have no cell at all


@pytest.mark.parametrize("n_shards, strip", [(1, 256), (3, 256), (3, 2)])
def test_steps_of_an_epoch_are_those_of_the_dense_matrix(spark, cells, n_shards, strip, monkeypatch):
    words, found = cells
    monkeypatch.setattr(swivel, "STRIP", strip)
    cooc = spark.createDataFrame(found, "row string, col string, weight long")
    vocabulary = spark.createDataFrame([(w,) for w in words], "token string")
    places = stored(swivel.placed(cooc, vocabulary, n_shards), "sides")
    blocks = stored(swivel.cells_by_row(cooc, places), "blocks")
    now = stored(swivel.start_vectors(places, 5), "vectors")
    rows = {(p.side, p.token): p for p in now.collect()}
    r, c = (np.array([rows[s, w].vector for w in words]) for s in ("row", "col"))
    rb, cb = (np.array([rows[s, w].bias for w in words]) for s in ("row", "col"))
    shard = np.array([rows["row", w].shard for w in words])
    x, total = dense(found, len(words), words), np.log1p(len(found))
    assert np.allclose(rb, np.log1p((x > 0).sum(1))) and np.allclose(cb, np.log1p((x > 0).sum(0)))
    assert sorted(np.bincount(shard)) == sorted(len(words[i::n_shards]) for i in range(n_shards))
    *_, l2, zeros = gradients(x, r, c, rb, cb, total, np.ones_like(x))
    assert np.allclose(tuple(swivel.losses(now, blocks, n_shards).first()), (l2, zeros))
    sr, sc = np.full_like(r, 0.1), np.full_like(c, 0.1)
    for shift in range(n_shards):
        mask = (shard[None] - shard[:, None]) % n_shards == shift
        dr, dc, l2, zeros = gradients(x, r, c, rb, cb, total, mask)
        made = stored(swivel.step(now, blocks, n_shards, shift, total), "vectors")
        loss = np.sum([p.vector for p in made.where("side = 'loss'").collect()], 0)
        assert np.allclose(loss, (l2, zeros))
        sr, sc = sr + dr**2, sc + dc**2
        r, c = r - dr / np.sqrt(sr), c - dc / np.sqrt(sc)
        now = made.where("side <> 'loss'")
        rows = {(p.side, p.token): p for p in now.collect()}
        assert len(rows) == 2 * len(words)
        for side, want, squares in (("row", r, sr), ("col", c, sc)):
            assert np.allclose([rows[side, w].vector for w in words], want) and np.allclose([rows[side, w].squares for w in words], squares)


def test_training_lowers_the_loss(spark, cells):
    words, found = cells
    cooc = spark.createDataFrame(found, "row string, col string, weight long")
    rows, cols, losses = swivel.trained(cooc, spark.createDataFrame([(w,) for w in words], "token string"), 2, dim=4, epochs=6, options=swivel.Options(multiplier=1.0))
    for side in (rows, cols):
        assert {r.token: len(r.embedding) for r in side.collect()} == dict.fromkeys(words, 4)
    sums = [a + b for a, b in losses]
    assert sums == sorted(sums, reverse=True) and sums[-1] < 0.8 * sums[0]


def test_start_vectors_depend_on_seed_and_token_alone(spark):
    places = spark.createDataFrame([("row", f"t{i}", 0, i, 0.0) for i in range(400)], "side string, token string, shard int, place long, bias double")
    one, again, other = (np.array([r.vector for r in swivel.start_vectors(p, 50, seed).orderBy("place").collect()]) for p, seed in ((places, 1), (places.repartition(5), 1), (places, 2)))
    assert (one == again).all() and not (one == other).any()
    assert abs(one.mean()) < 0.01 and abs(one.std() * np.sqrt(50) - 1) < 0.02


def test_preprocessing_rounds_and_refuses(spark):
    cooc = spark.createDataFrame([("a", "b", 2.0), ("b", "a", 2.0), ("a", "z", 1.0)], "row string, col string, weight double")
    docfreq = spark.createDataFrame([("a", 9), ("b", 8), ("c", 7), ("d", 6), ("z", 1)], "token string, freq long")
    made, words, n = swivel.prepared(cooc, docfreq, 10, 2)
    assert n == 2 and {r.token for r in words.collect()} == {"a", "b", "c", "d"}
    assert sorted(map(tuple, made.collect())) == [("a", "b", 2.0), ("b", "a", 2.0)]
    assert swivel.effective_size(7, 100, 7) == 7 and swivel.effective_size(100, 17, 8) == 16
    with pytest.raises(ValueError, match="smaller than a shard"):
        swivel.prepared(cooc, docfreq, 3, 4)
    for bad, why in ((-1.0, "negative"), (float("nan"), "nan"), (None, "empty")):
        with pytest.raises(Exception, match=why):
            swivel.prepared(cooc.unionByName(cooc.limit(1).withColumn("weight", F.lit(bad).cast("double"))), docfreq, 10, 2)


def test_commands_from_matrix_to_embeddings(spark, tmp_path, cells):
    from lodestone import cli, models

    words, found = cells
    docfreq = spark.createDataFrame([(w, 30 - i) for i, w in enumerate(words)], "token string, freq long")
    models.save(docfreq, f"{tmp_path}/df", "docfreq")
    _, own = models.load(spark, f"{tmp_path}/df")
    models.save(spark.createDataFrame(found, "row string, col string, weight long"), f"{tmp_path}/cooc", "cooccurrences", [own["uuid"]])
    models.save(docfreq, f"{tmp_path}/other", "docfreq")
    run = lambda *args: (lambda a: a.handler(spark, a))(cli.get_parser().parse_args([*args]))
    prepare = ("id2vec-preproc", "--inputs", f"{tmp_path}/cooc", "--shard-size", "8")
    with pytest.raises(ValueError, match="was not made with"):
        run(*prepare, "--docfreq", f"{tmp_path}/other", "--output", f"{tmp_path}/no")
    run(*prepare, "--docfreq", f"{tmp_path}/df", "--output", f"{tmp_path}/pre")
    assert models.load(spark, f"{tmp_path}/pre/cells")[1]["shards"] == 2  # 16 of 23 words
    run("id2vec-train", "--input", f"{tmp_path}/pre", "--dim", "3", "--epochs", "1", "--output", f"{tmp_path}/vectors")
    run("id2vec-postproc", "--rows", f"{tmp_path}/vectors/rows", "--cols", f"{tmp_path}/vectors/cols", "--output", f"{tmp_path}/id2vec")
    made, _ = models.load(spark, f"{tmp_path}/id2vec", "id2vec")
    assert {r.token: len(r.embedding) for r in made.collect()} == dict.fromkeys(words[:16], 3)
