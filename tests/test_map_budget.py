"""The registered mapping is of all reads, with the operator's own budget."""

import inspect

import __spark_entry__ as entry
from cytoloom.operators import alignment, single
from cytoloom.plans import virtual


def test_map_single_end_takes_every_read_and_the_default_budget(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "ACGTACG"), (2, "ACGTACGTACGTACGTACGTACGT")], "read_id bigint, seq string")
    places = spark.createDataFrame([("c", "ACGT" * 20)], "contig string, seq string")
    monkeypatch.setattr(virtual, "reads", lambda *_: rows)
    monkeypatch.setattr(virtual, "contigs", lambda *_: places)
    seen, signature = {}, inspect.signature(single.map_reads)

    def mapped(*args, **kwargs):
        call = signature.bind(*args, **kwargs)
        call.apply_defaults()
        seen.update(edits=call.arguments["edits"], ids={r.read_id for r in call.arguments["reads"].collect()})
        names = "status string, mapq int, contig string, strand string, start bigint, end bigint, distance int"
        return spark.createDataFrame([], f"read_id bigint, {names}")

    monkeypatch.setattr(single, "map_reads", mapped)
    entry.queries()["map_single_end"](spark, "")
    assert seen == {"edits": alignment.MAX_EDITS, "ids": {1, 2}}
