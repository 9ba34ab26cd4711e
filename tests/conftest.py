import json
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def make_log(spark, tmp_path):
    """A log from a plain document {objects, events}."""
    from tracewright.sources.ocel import read_document

    def make(objects, events):
        path = tmp_path / f"log{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps({"objects": objects, "events": events}))
        return read_document(spark, str(path))
    return make


def attributes(**kw):
    return [{"name": k, "value": v} for k, v in kw.items()]


def event(id_, type_, time, links, **attrs):
    return {"id": id_, "type": type_, "time": time, "attributes": attributes(**attrs),
            "relationships": [{"objectId": x} for x in links]}


def obj(id_, type_, **attrs):
    return {"id": id_, "type": type_, "attributes": attributes(**attrs)}
