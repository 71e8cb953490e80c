"""Prompts of a large batch."""

from proofline.operators import runs


def test_prompts_come_a_few_at_a_time(spark):
    """a whole batch of 10,000 prompts became Python's at once."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(1000))), pa.array(["p"] * 1000)], ["item_id", "prompt"])
    assert max(len(c[1]) for c in runs.sliced(iter([batch]))) <= 64 and sum(len(c[0]) for c in runs.sliced(iter([batch]))) == 1000
    got = runs.collect(spark.createDataFrame([("1", "x"), ("2", None)], "item_id string, prompt string"), lambda p: f"<{p}>").collect()
    assert {r.item_id: r.reply for r in got} == {"1": "<x>", "2": "<None>"}
