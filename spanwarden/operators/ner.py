"""Token classification as spans: log-softmax, constrained BIOES decoding, character spans; logits come from a model or a column."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import SPANS

# Categories in label order, the classes that they stand for, the confidence and the recognizer's name.
CATEGORIES = ("account_number", "private_address", "private_date", "private_email", "private_person", "private_phone", "private_url", "secret")
ENTITY = {"secret": "secret", "account_number": "account_number", "private_person": "person", "private_address": "private_address", "private_email": "email", "private_phone": "phone", "private_url": "private_url", "private_date": "private_date"}
CONFIDENCE, RECOGNIZER = 0.85, "token-classifier"
LABELS = ("O", *(f"{tag}-{c}" for c in CATEGORIES for tag in "BIES"))


def log_softmax(logits: np.ndarray) -> np.ndarray:
    top = logits.max(axis=1, keepdims=True)
    return logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))


def legal() -> np.ndarray:
    """[from, to]: O, E and S are followed by O, B or S; B and I by I or E of their own category."""
    out = np.zeros((len(LABELS), len(LABELS)), bool)
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            out[i, j] = b[2:] == a[2:] and b[0] in "IE" if a[0] in "BI" else b[0] in "OBS"
    return out


_LEGAL = legal()
_START = np.array([x[0] in "BSO" for x in LABELS])
_END = np.array([x[0] in "ESO" for x in LABELS])


def viterbi(log_p: np.ndarray, bias: np.ndarray | None = None) -> list[int]:
    """The best legal label sequence; it starts in B, S or O and ends in E, S or O. `bias` is added to transitions."""
    n = len(log_p)
    if not n:
        return []
    step = np.where(_LEGAL, 0.0 if bias is None else bias, -np.inf)
    score = np.where(_START, log_p[0], -np.inf)
    back = np.zeros((n, len(LABELS)), int)
    for t in range(1, n):
        every = score[:, None] + step
        back[t] = every.argmax(axis=0)
        score = every.max(axis=0) + log_p[t]
    last = int(np.where(_END, score, -np.inf).argmax())
    path = [last]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return path[::-1]


def token_spans(labels: list[int]) -> list[tuple[str, int, int]]:
    """(category, first token, token after the last). Malformed sequences are closed where they break."""
    out, category, start = [], None, 0

    def close(at):
        nonlocal category
        if category is not None:
            out.append((category, start, at))
        category = None

    for i, label in enumerate(labels):
        name = LABELS[label]
        tag, own = name[0], name[2:]
        if tag == "O":
            close(i)
        elif tag in "BS":
            close(i)
            category, start = own, i
            if tag == "S":
                close(i + 1)
        else:
            if category != own:
                close(i)
                category, start = own, i
            if tag == "E":
                close(i + 1)
    close(len(labels))
    return out


def char_spans(text: str, labels: list[int], starts: list[int], ends: list[int]) -> list[tuple[str, int, int]]:
    """(class, start, end) in characters, without surrounding white space; empty spans are dropped."""
    out = []
    for category, a, b in token_spans(labels):
        s, e = starts[a], ends[b - 1]
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if e > s:
            out.append((ENTITY[category], s, e))
    return out


def offsets(tokens: list[bytes]) -> tuple[list[int], list[int]]:
    """Character ranges of byte tokens by decoding growing prefixes: tokens that split a character share its range."""
    starts, ends, data, done = [], [], b"", 0
    for t in tokens:
        starts.append(done)
        data += t
        text = data.decode("utf-8", "ignore")
        whole = len(text.encode()) == len(data)
        ends.append(len(text) if whole else len(text) + 1)
        done = len(text)
    return starts, ends


def decode(df: DataFrame, text_col: str, logits_col: str, starts_col: str, ends_col: str) -> DataFrame:
    """`df` with column `spans` from injected logits (flat, one row of len(LABELS) a token) and character ranges."""

    @F.pandas_udf(SPANS)
    def run(text: pd.Series, logits: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, x, s, e in zip(text, logits, starts, ends, strict=True):
            flat = np.asarray(x if x is not None else [], float).reshape(-1, len(LABELS))
            found = char_spans(t or "", viterbi(log_softmax(flat)) if len(flat) else [], list(s) if s is not None else [], list(e) if e is not None else [])
            out.append([{"entity": c, "start": a, "end": b, "confidence": CONFIDENCE, "recognizer": RECOGNIZER, "path": "", "value": t[a:b]} for c, a, b in found])
        return pd.Series(out)

    return df.withColumn("spans", run(*[F.col(f"`{c}`") for c in (text_col, logits_col, starts_col, ends_col)]))


def model_recognizer(load: Callable[[], Callable[[str], tuple[np.ndarray, list[int], list[int]]]]) -> Callable[[pd.Series], pd.Series]:
    """A pandas function text -> spans whose model is loaded once a worker, on its first text. If loading or running fails it gives nothing from then on."""
    state: dict = {}

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            if state.get("off") or not text:
                return []
            try:
                if "model" not in state:
                    state["model"] = load()
                logits, starts, ends = state["model"](text)
                found = char_spans(text, viterbi(log_softmax(logits)), starts, ends)
                return [{"entity": c, "start": a, "end": b, "confidence": CONFIDENCE, "recognizer": RECOGNIZER, "path": "", "value": text[a:b]} for c, a, b in found]
            except Exception:  # noqa: BLE001  without its model this tier is off
                state["off"] = True
                return []

        return texts.map(one)

    return run
