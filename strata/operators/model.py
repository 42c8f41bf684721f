"""Running a model over a table of prompts. The model is a callable the user passes in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.replies import FENCE

ModelFn = Callable[[Sequence[str]], Sequence[str]]
CheckFn = Callable[[str], str | None]

#: What `trim_all` takes off a reply before it is parsed.
WHITE_SPACE = " \t\n\x0b\f\r"

# How often a prompt is tried.
MAX_ATTEMPTS = 3


def json_problem(reply: str) -> str | None:
    """What is wrong with a reply that should be JSON, or None. Code fences around it are fine."""
    text = reply.strip(WHITE_SPACE)
    if text.startswith(FENCE):
        marked = f"{FENCE}json" if text.startswith(f"{FENCE}json") else FENCE
        text = text.replace(marked, "").replace(FENCE, "")
    try:
        json.loads(text)
    except ValueError as e:
        return f"not valid JSON: {e}"
    return None


def _with_feedback(prompt: str, problem: str) -> str:
    return f"{prompt}\n\nYour previous answer could not be used.\nERROR: {problem}\nPlease send a corrected one."


def extract_records(
    prompts: DataFrame,
    model_fn: ModelFn,
    prompt_col: str = "prompt",
    max_attempts: int = MAX_ATTEMPTS,
    check: CheckFn = json_problem,
    batch_size: int = 64,
    tasks: int | None = None,
) -> DataFrame:
    """Add `reply`, `attempts` and `error`, in place of the prompt column.

    Prompts go to the model in batches. Those whose reply fails the check are sent again with the
    problem appended, up to `max_attempts` times in all; after that the reply is null and `error`
    says why. `tasks` sets how many calls run at once. A lost executor repeats its calls, so store
    the replies (`store_cached`) before anything is built on them.
    """
    others = [c for c in prompts.columns if c != prompt_col]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields if f.name in others)
    schema = f"{kept + ', ' if kept else ''}reply string, attempts int, error string"

    def ask(texts: list[str]) -> tuple[list[str | None], list[int], list[str | None]]:
        replies, tries, errors = [None] * len(texts), [0] * len(texts), [None] * len(texts)
        open_at, asked = list(range(len(texts))), list(texts)
        for _ in range(max_attempts):
            try:
                answers = list(model_fn([asked[i] for i in open_at]))
                if len(answers) != len(open_at):
                    raise ValueError(f"{len(answers)} answers to {len(open_at)} prompts")
                problems = [check(a) for a in answers]
            except Exception as e:
                answers, problems = [None] * len(open_at), [str(e) or type(e).__name__] * len(open_at)
            for i, answer, problem in zip(open_at, answers, problems, strict=True):
                tries[i] += 1
                errors[i] = problem
                if problem is None:
                    replies[i] = answer
                else:
                    asked[i] = _with_feedback(texts[i], problem)
            open_at = [i for i in open_at if errors[i] is not None]
            if not open_at:
                break
        return replies, tries, errors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                piece = batch.iloc[start : start + batch_size]
                replies, tries, errors = ask(piece[prompt_col].tolist())
                yield piece[others].assign(reply=replies, attempts=tries, error=errors)

    spread = prompts.repartition(tasks) if tasks else prompts
    return spread.select(*others, F.coalesce(prompt_col, F.lit("")).alias(prompt_col)).mapInPandas(run, schema)
