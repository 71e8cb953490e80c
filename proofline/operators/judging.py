"""Judges: the questions of each kind of field, how replies are read, who is asked, and what comes back as verdicts."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from proofline.operators import evidence, runs
from proofline.operators.assigned import is_judgeable

VERDICTS = "item_id string, judge string, field string, reply string, latency_ms double, outcome string"


class ProviderFailed(ConnectionError):
    """A provider did not answer after all retries."""


def has_text(value: Column) -> Column:
    """Whether there is something to judge: not null and not blank."""
    return F.coalesce(F.regexp_replace(value.cast("string"), r"[ \t\n\r\f\v]+", "") != "", F.lit(False))


@dataclass(frozen=True)
class Task:
    """One kind of question: which check it feeds, how it is put, how a reply is read, and what can be judged at all."""

    check: str
    ask: str
    read: Callable[[DataFrame], DataFrame]
    judgeable: Callable[[Column], Column]
    gated: bool  # whether free checks decide which rows are asked about


#: By kind of field. Free checks of an assigned label only catch its form, so all of its rows are asked about.
TASKS: dict[str, Task] = {
    "assigned": Task("label_correct", "Is this label right?", runs.parse_replies, is_judgeable, False),
    "free_text": Task("claims_supported", "Which claims does the item support?", evidence.parse_claims, has_text, True),
    "copied": Task("value_grounded", "Is this the value that the item supports?", runs.parse_replies, has_text, True),
}


def questions(rows: DataFrame, kind: str, field: str, judges: Sequence[str]) -> DataFrame:
    """(item_id, judge, field, prompt, key) of rows (item_id, text, value): one for each judge and row that can be judged."""
    task = TASKS[kind]
    prompt = F.concat(F.lit(f"{task.ask}\n\nITEM:\n"), F.coalesce("text", F.lit("")), F.lit(f"\n\n{field}: "), F.col("value").cast("string"))
    asked = rows.filter(task.judgeable(F.col("value"))).select("item_id", F.explode(F.array(*map(F.lit, judges))).alias("judge"), F.lit(field).alias("field"), prompt.alias("prompt"))
    return asked.withColumn("key", F.sha2(F.concat_ws("\0", "judge", "field", "prompt"), 256))


def by_rules(rules: Sequence[tuple[str, str | None]], default: str) -> Callable[[str], str]:
    """A provider that answers from a list: the first text that stands in the prompt decides; a null answer is a failure."""

    def ask(prompt: str) -> str:
        reply = next((r for needle, r in rules if needle in prompt), default)
        if reply is None:
            raise ProviderFailed("the list says to fail")
        return reply

    return ask


def over_http(send: Callable[[Mapping], tuple[int, str]], model: str, retries: int = 3, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """A provider over any transport: send takes a request's body and gives (status, text of the answer).

    Too many requests, errors of the server and timeouts are tried again after a wait that doubles and is spread; other
    refusals are not. The transport brings address and key, so neither is known here.
    """

    def ask(prompt: str) -> str:
        last = "no answer"
        for k in range(retries + 1):
            if k:
                sleep(wait * 2 ** (k - 1) * (1 + random.random() / 4))
            try:
                status, text = send({"model": model, "prompt": prompt})
            except (TimeoutError, ConnectionError) as e:
                last = repr(e)
                continue
            if status == 200:
                return text
            last = f"status {status}"
            if status != 429 and status < 500:
                break
        raise ProviderFailed(last)

    return ask


def ask(questions_: DataFrame, providers: Mapping[str, Callable[[str], str]]) -> DataFrame:
    """(item_id, judge, field, reply, latency_ms, outcome) of questions: asked in the tasks, a batch at a time; outcome is
    `answered` or `error`, and a judge without a provider is an error.
    """

    def one(judge: str, prompt: str) -> tuple[str | None, float, str]:
        began = time.perf_counter()
        try:
            reply, outcome = providers[judge](prompt), "answered"
        except (TimeoutError, ConnectionError, KeyError):
            reply, outcome = None, "error"
        return reply, round((time.perf_counter() - began) * 1000, 1), outcome

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, judge, field, prompts in runs.sliced(batches):
            got = [one(j, p) for j, p in zip(judge.to_pylist(), prompts.to_pylist())]
            said = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([ids, judge, field, *said], ["item_id", "judge", "field", "reply", "latency_ms", "outcome"])

    return questions_.select(*(F.col(c).cast("string").alias(c) for c in ("item_id", "judge", "field", "prompt"))).mapInArrow(run, VERDICTS)


def verdicts(replies: DataFrame, kind: str) -> DataFrame:
    """(item_id, judge, field, check, status, confidence): replies as the task of the kind reads them; a failed call is an error."""
    task = TASKS[kind]
    keyed = replies.withColumn("item_id", F.to_json(F.struct("item_id", "judge", "field", "outcome")))
    read = task.read(keyed.select("item_id", "reply")).withColumn("k", F.from_json("item_id", "item_id string, judge string, field string, outcome string"))
    status = F.when(F.col("k.outcome") == "error", "error").otherwise(F.col("status"))
    return read.select("k.item_id", "k.judge", "k.field", F.lit(task.check).alias("check"), status.alias("status"), "confidence")


def collect_run(triage: DataFrame, panel: DataFrame, gated: DataFrame, cache: DataFrame) -> DataFrame:
    """The questions that three passes have to ask, each once and none that the cache answers: (item_id, judge, field, prompt, key, selected_by).

    A question of several passes belongs to the first of them: triage, then panel, then gated.
    """
    part = lambda df, k, name: df.select("item_id", "judge", "field", "prompt", "key", F.struct(F.lit(k).alias("k"), F.lit(name).alias("name")).alias("pass"))
    every = part(triage, 0, "triage").unionByName(part(panel, 1, "panel")).unionByName(part(gated, 2, "gated"))
    once = every.groupBy("key").agg(F.min("pass").alias("pass"), *(F.min(c).alias(c) for c in ("item_id", "judge", "field", "prompt")))
    return once.join(cache.select("key").distinct(), "key", "left_anti").select("item_id", "judge", "field", "prompt", "key", F.col("pass.name").alias("selected_by"))


def regenerate(items: DataFrame, provider: Callable[[str], str], field: str, attempts: int = 3) -> DataFrame:
    """(item_id, generation, value): the producing model asked again; replies without the field are null, for stability() to leave out."""
    again = items.select("item_id", "text", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("generation"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, generation in runs.sliced(batches):
            yield pa.RecordBatch.from_arrays([ids, generation, pa.array([read_field(_safe(provider, t), field) for t in texts.to_pylist()], pa.string())], ["item_id", "generation", "value"])

    return again.select(F.col("item_id").cast("string"), "text", F.col("generation").cast("long")).mapInArrow(run, "item_id string, generation long, value string")


def _safe(provider: Callable[[str], str], prompt: str | None) -> str | None:
    try:
        return provider(prompt or "")
    except (TimeoutError, ConnectionError):
        return None


def read_field(reply: str | None, field: str) -> str | None:
    """The field of the object between the first { and the last } of a reply; null if there is none."""
    text = reply or ""
    low, high = text.find("{"), text.rfind("}")
    try:
        body = json.loads(text[low : high + 1]) if 0 <= low < high else None
    except json.JSONDecodeError:
        return None
    value = body.get(field) if isinstance(body, dict) else None
    return None if value is None else str(value)
