import numpy as np
import pytest

from tracewright.llm import neighbours


def by_hand(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u @ u.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    name = np.arange(len(x))
    while (new := np.minimum(name, np.where(s, name[None, :], len(x)).min(1))).tolist() != name.tolist():
        name = new
    return [(i, int(s[i].sum()), int(name[i])) for i in range(len(x))]


def table(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")


def test_links_between_groups_whose_lists_are_full(spark, monkeypatch):
    """Pairs of tight groups; each member has more than LIST nearer vectors in its own group than any of the other, and the first descent meets none of these."""
    rng = np.random.default_rng(3)
    x = []
    for _ in range(4):
        q, _ = np.linalg.qr(rng.normal(size=(24, 2)))
        for angle in (0, np.arccos(0.945)):
            x.append(np.cos(angle) * q[:, 0] + np.sin(angle) * q[:, 1] + 0.004 * rng.normal(size=(20, 24)))
    x = np.concatenate(x)
    whole = neighbours._descent

    def apart(nodes, threshold, turn, kin=None):
        ties, lists = whole(nodes, threshold, turn, kin)
        return (ties.where("floor(a / 20) = floor(b / 20)") if kin is None else ties), lists

    monkeypatch.setattr(neighbours, "_descent", apart)
    monkeypatch.setattr(neighbours, "TURNS", 1)
    out, recall = neighbours.near_vectors(table(spark, x).coalesce(1), 0.93)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()) == by_hand(x) and recall == 1


def test_a_failed_audit_fails_the_run(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "audit", lambda *_: 0.5)
    monkeypatch.setattr(neighbours, "TURNS", 1)
    with pytest.raises(RuntimeError, match="0.5000"):
        neighbours.near_vectors(table(spark, np.random.default_rng(1).normal(size=(20, 8))), 0.93)
