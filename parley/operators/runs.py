"""Run records: exits, budgets, usage, failure codes (AG-17, AG-18, SN-9, SN-15, CP-18..20, FLT-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Budgets in units and ms, by workflow.
BUDGETS = {"process-meeting": (60, 180_000), "notes": (12, 150_000), "handoff": (12, 150_000), "cross-handoff": (16, 180_000), "ask": (3, 15_000), "needle": (4, 20_000), "chat": (4, 30_000), "diarize": (2, 600_000), "project-ask": (3, 30_000), "doc-summary": (2, 30_000)}
#: The failure codes with what a user is told.
LABELS = {
    "model-timeout": "the model call timed out",
    "model-rate-limited": "the model host rate-limited us",
    "model-http": "the model host returned an error",
    "model-unreachable": "the model host could not be reached",
    "model-unconfigured": "no model is configured",
    "model-bad-json": "the model did not return usable JSON",
    "schema-invalid": "the model's JSON did not match the schema",
    "grounding-blocked": "the output failed the grounding gate",
    "entailment-unsupported": "the cited transcript does not support the claim",
    "budget-exhausted": "the run's unit budget was exhausted",
    "deadline-exceeded": "the run's deadline passed",
    "no-transcript": "no transcript exists yet",
    "no-statements": "nothing in the transcript survived extraction",
    "no-retrieval": "retrieval found nothing relevant",
    "not-found": "the requested record does not exist",
    "upstream-failed": "an upstream service failed",
    "network-failed": "a network request failed",
    "skipped-local-only": "skipped — running local-only",
    "crash": "something went wrong",
    "info": "",
}
#: What an error's message means that has no status, and one of a host that was never reached (status 0).
MESSAGES = [
    ("model-bad-json", r"(?i)did not return JSON"),
    ("schema-invalid", r"(?i)^schema:"),
    ("network-failed", r"(?i)fetch failed|ECONNREFUSED|ENOTFOUND|ETIMEDOUT|EAI_AGAIN|socket hang up|network"),
]
UNREACHED = [("model-timeout", r"(?i)timed out"), ("model-unconfigured", r"(?i)API_KEY|not set|no mock")]


def _first(message: Column, patterns: list[tuple[str, str]], otherwise: str) -> Column:
    return F.coalesce(*(F.when(message.rlike(p), code) for code, p in patterns), F.lit(otherwise))


def failure_code(message: Column, status: Column | None = None, code: Column | None = None) -> Column:
    """The code of an error (CP-19): the one it carries, else by the status of the model's host (429, 0 for a
    host that was not reached, any other), else by its message; crash if nothing fits."""
    said = F.coalesce(message, F.lit(""))
    plain = _first(said, MESSAGES, "crash")
    if status is not None:
        of_host = F.when(status == 429, "model-rate-limited").when(status == 0, _first(said, UNREACHED, "model-unreachable")).otherwise("model-http")
        plain = F.when(status.isNotNull(), of_host).otherwise(plain)
    return plain if code is None else F.coalesce(code, plain)


def label_of(code: Column) -> Column:
    """What a user is told: never the detail; an unknown code says as much as a crash."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[code], F.lit(LABELS["crash"]))


def budget_reason(units: Column, ms: Column, max_units: Column, max_ms: Column) -> Column:
    """Time is checked first and may reach its limit; units may not (SN-15)."""
    return F.when(ms > max_ms, "deadline-exceeded").when(units >= max_units, "budget-exhausted")


def decide_exit(steps: Column, reason: Column) -> Column:
    """deadline, else failed if a core step failed, else partial if any step did not end well, else
    shipped; steps is array<struct<name,status>> (AG-18, CP-18)."""
    core = F.exists(steps, lambda s: (s["status"] == "failed") & s["name"].startswith("core:"))
    some = F.exists(steps, lambda s: s["status"].isin("failed", "blocked", "skipped"))
    return F.when(reason.isNotNull(), "deadline").when(core, "failed").when(some, "partial").otherwise("shipped")


def legacy_exit(x: Column) -> Column:
    return F.when(x == "budget", "deadline").otherwise(x)


def first_failure(steps: Column) -> Column:
    """The first failed step, else the first blocked one (CP-20)."""
    pick = lambda s: F.try_element_at(F.filter(steps, lambda x: x["status"] == s), F.lit(1))
    return F.coalesce(pick("failed"), pick("blocked"))


def cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """tokens / 1000 * price, in USD for 1000 tokens in and out by model (from the configuration); 0 for a
    model without a price (SN-9)."""
    out = F.lit(0.0)
    for name, (i, o) in prices.items():
        out = F.when(model == name, tokens_in / 1000 * i + tokens_out / 1000 * o).otherwise(out)
    return out


def usage_since(calls: DataFrame, cursor: int, ring: int = 200) -> DataFrame:
    """Tokens since a cursor over the last `ring` calls (AG-17). Columns id, tokens_in, units."""
    last = calls.orderBy(F.desc("id")).limit(ring).where(F.col("id") > cursor)
    return last.agg(F.count("*").alias("calls"), F.coalesce(F.sum("tokens_in"), F.lit(0).cast("long")).alias("tokens_in"))


def for_ui(runs: DataFrame) -> DataFrame:
    """Runs without steps and details, with a label for the outcome (FLT-17)."""
    label = F.when(F.col("outcome") == "shipped", "Done").when(F.col("outcome") == "partial", "Done, with gaps").when(F.col("outcome") == "deadline", "Ran out of time").otherwise("Failed")
    return runs.select("id", "kind", "meeting_id", "started_at", "outcome", label.alias("label"))


def attempts(tries: DataFrame, most: int = 3) -> DataFrame:
    """(name, status, attempts) of scripted tries (name, attempt, ok): the first that succeeds within the
    allowed number ends a step (CP-18, TREE-9)."""
    rows = tries.where(F.col("attempt") <= most)
    first = F.min(F.when(F.col("ok"), F.col("attempt")))
    return rows.groupBy("name").agg(first.alias("won"), F.max("attempt").alias("last")).select("name", F.when(F.col("won") == 1, "ok").when(F.col("won").isNotNull(), "retried").otherwise("failed").alias("status"), F.coalesce("won", "last").alias("attempts"))


def step_records(tries: DataFrame, most: int = 3) -> DataFrame:
    """(name, status, attempts, code, aimed_with) of scripted tries (name, attempt, ok, message, http_status, stop):
    a bounded, aimed retry (CP-18). A try that the budget stops (stop holds its code) is never made and ends the
    step as skipped; the first that succeeds ends it as ok or retried; else the last one's failure stands.
    aimed_with holds the messages that later tries were given, in order."""
    rows = tries.where(F.col("attempt") <= most).withColumn("end", F.when(F.col("stop").isNotNull(), "skipped").when(F.col("ok"), F.when(F.col("attempt") == 1, "ok").otherwise("retried")))
    rows = rows.withColumn("code", F.coalesce("stop", F.when(~F.col("ok"), failure_code(F.col("message"), F.col("http_status")))))
    steps = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("attempt", "end", "code", "message"))).alias("t"))
    ended = F.filter("t", lambda x: x["end"].isNotNull())
    last = F.coalesce(F.get(ended, F.lit(0)), F.element_at("t", -1))
    made = F.filter("t", lambda x: x["attempt"] < last["attempt"])
    return steps.select("name", F.coalesce(last["end"], F.lit("failed")).alias("status"), (last["attempt"] - F.when(last["end"] == "skipped", 1).otherwise(0)).alias("attempts"), F.when(~F.coalesce(last["end"].isin("ok", "retried"), F.lit(False)), last["code"]).alias("code"), F.transform(made, lambda x: F.coalesce(x["message"], F.lit(""))).alias("aimed_with"))


def backoff_ms(attempt: int, base: int = 400) -> int:
    """base * 2^(attempt - 1) (SN-13)."""
    return base * 2 ** (attempt - 1)


def ring_buffer(events: DataFrame, key: str, size: int = 200) -> DataFrame:
    """The last `size` events of each key by sequence, for late subscribers (STR-7)."""
    by = Window.partitionBy(key).orderBy(F.desc("seq"))
    return events.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= size).drop("_n")
