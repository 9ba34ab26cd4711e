import re

from tracewright.llm import secrets


def test_positions_beyond_one_block(spark):
    """Very many matches of one text stand where a plain scan finds them, also after letters beyond ASCII; ties of kinds keep their order."""
    text = "".join(f"é {i} password=abcdefgh{i:04d} ü " + "0123456789abcdef" * 2 * (i % 3) + " " for i in range(3 * secrets.BLOCK + 1))
    want = [("assign", m.start(), m.end()) for m in re.finditer(secrets.ASSIGN[4:].replace("\\x20", " "), text, re.I)]
    want += [("hex", m.start(), m.end()) for m in re.finditer(secrets.HEX, text)]
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, text)], "doc_id long, text string")
    got = secrets.find_secrets(docs, [0.0] * secrets.CODES ** 2).collect()
    for r in got:
        found = [(s["kind"], s["start"], s["end"]) for s in r["secrets"]]
        assert found == (sorted(want, key=lambda x: (x[1], secrets.KINDS.index(x[0]))) if r["text"] else [])
        assert all(text[s["start"]:s["end"]].endswith(s["value"]) for s in r["secrets"])


def test_empty_table_and_older_column(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, secrets string")
    assert secrets.find_secrets(docs, [0.0] * secrets.CODES ** 2).count() == 0
