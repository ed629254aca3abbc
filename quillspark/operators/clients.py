"""Models behind a service, as columns: one request a prompt, with retries.

`asking` makes a model for `enrichment`, `evaluation` and `answers` from a
function of one prompt. Requests of a batch are sent side by side; one that
fails in a way that may pass is sent again after a wait that doubles, and one
that keeps failing is an answer with an error, so no request ends a job.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

from quillspark.operators.answers import Model


@dataclass(frozen=True)
class Reply:
    """What a service says to one prompt."""

    text: str
    input_tokens: int | None = None
    output_tokens: int | None = None


class Unavailable(RuntimeError):
    """The service can't answer now: a limit of its rate, a time-out, a failure of its own."""


def persistent(send: Callable[[str], Reply], attempts: int = 5, wait: float = 1.0, most_wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple]:
    """(text, error, input_tokens, output_tokens) of a prompt, after `attempts` tries at most."""

    def ask(prompt: str) -> tuple:
        for turn in range(attempts):
            try:
                reply = send(prompt)
                return reply.text, None, reply.input_tokens, reply.output_tokens
            except (Unavailable, TimeoutError, ConnectionError) as why:
                error = f"{type(why).__name__}: {why}"
            except Exception as why:  # asking again would not help
                return None, f"{type(why).__name__}: {why}", None, None
            if turn + 1 < attempts:
                sleep(min(wait * 2**turn, most_wait) * (1 + random.random() / 4))
        return None, f"gave up after {attempts} attempts: {error}", None, None

    return ask


def asking(send: Callable[[str], Reply], attempts: int = 5, wait: float = 1.0, at_once: int = 8) -> Model:
    """A model of `send`, which is taken to the executors; each task has `at_once` requests in flight at most."""

    @F.pandas_udf("text string, error string, input_tokens int, output_tokens int")
    def asked(prompts: pd.Series) -> pd.DataFrame:
        ask = persistent(send, attempts, wait)
        with ThreadPoolExecutor(at_once) as pool:
            rows = list(pool.map(lambda p: (None, "no prompt", None, None) if p is None else ask(p), prompts))
        made = pd.DataFrame(rows, columns=["text", "error", "input_tokens", "output_tokens"])
        return made.astype({"input_tokens": "Int32", "output_tokens": "Int32"})

    return asked
