"""Reading, writing and looking through process models."""

from tracewright.operators import conformance as N


def model(spark, nodes, flows):
    return N.ProcessModel(spark.createDataFrame(nodes, N.NODES), spark.createDataFrame(flows, N.FLOWS))


def allowed(spark, m, tasks):
    found = N.look_through(m, spark.createDataFrame(tasks, "node_id string, activity string"))
    return {(r["flow_id"], r["source"], r["target"]) for r in found.collect()}


def test_long_chain_of_gateways(spark):
    names = ["a", *[f"g{i}" for i in range(300)], "b"]
    m = model(spark, [(n, "activity" if n in "ab" else "other", "") for n in names], [(f"f{i}", x, y) for i, (x, y) in enumerate(zip(names, names[1:]))])
    assert allowed(spark, m, [("a", "Cut"), ("b", "Glue")]) == {(f"f{i}", "Cut", "Glue") for i in range(301)}


def test_nested_splits_and_loops(spark):
    """Twenty splits in a row with two branches each have a million ways through, and a flow leads back to the first."""
    nodes, flows = [("s", "start", ""), ("a", "activity", ""), ("b", "activity", ""), ("e", "end", "")], [("in", "s", "a"), ("f0", "a", "x0"), ("out", "x20", "b"), ("again", "x20", "x0"), ("last", "b", "e")]
    for i in range(21):
        nodes.append((f"x{i}", "other", ""))
    for i in range(20):
        for side in "lr":
            nodes.append((f"{side}{i}", "other", ""))
            flows += [(f"{side}{i}i", f"x{i}", f"{side}{i}"), (f"{side}{i}o", f"{side}{i}", f"x{i + 1}")]
    got = allowed(spark, model(spark, nodes, flows), [("a", "Cut"), ("b", "Glue")])
    inner = {f for f, *_ in flows} - {"in", "last"}
    assert got == {(f, "Cut", "Glue") for f in inner} | {("in", N.BEGIN, "Cut"), ("last", "Glue", N.FINISH)}


def test_file_round_trip(spark, tmp_path):
    nodes = [("s", "start", ""), ("t1", "activity", 'Cut & "glue" <fast>'), ("g", "other", "why?"), ("e", "end", "it's over")]
    flows = [("f1", "s", "t1"), ("f2", "t1", "g"), ("f3", "g", "e")]
    N.write_bpmn(model(spark, nodes, flows), f"{tmp_path}/model")
    back = N.read_bpmn(spark, f"{tmp_path}/model")
    assert sorted(map(tuple, back.nodes.collect())) == sorted(nodes) and sorted(map(tuple, back.flows.collect())) == sorted(flows)


def test_other_spelling(spark, tmp_path):
    (tmp_path / "m.xml").write_text("""<definitions><process id='P'><!-- <task id="no" name="no"/> --><subProcess id="sub"
        name="Outer"><userTask
        name='Say "hi"' id='u1'><incoming>f</incoming></userTask></subProcess><sequenceFlow id="f" sourceRef="sub" targetRef="u1"/></process></definitions>""")
    m = N.read_bpmn(spark, str(tmp_path / "m.xml"))
    assert sorted(map(tuple, m.nodes.collect())) == [("sub", "activity", "Outer"), ("u1", "activity", 'Say "hi"')]
    assert [tuple(r) for r in m.flows.collect()] == [("f", "sub", "u1")]
