"""Questions answered from retrieved context and scored against the queries' own results.

For each question: gold rows by its query, context by the neighbourhood of the names in the query, an answer from a
cache or a responder, both made canonical, then matched. Questions are few and their contexts bounded by what a
prompt holds, so they are handled one by one on the driver; each step on the graph is a distributed plan.
"""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import BASE
from ..operators import retrieval as R
from ..operators import scoring as S
from ..sources.sinks import save_json, stable_text, text_hash
from ..sources.tables import question_of
from .planner import run

LOG = logging.getLogger(__name__)
Responder = Callable[[list[dict], int], str]  #: messages and seed to a reply


@dataclass
class Settings:
    base: str = BASE
    prefixes: dict[str, str] = field(default_factory=dict)
    depth: int | None = 1  #: None: the whole graph as context
    lenience: float = 0.0
    model: str = "none"
    runs: int = 1
    seed: int = 0
    seed_step: int = 1
    cache_only: bool = True
    #: most gold rows and triples of a context that a question may have; more is an error, as they go through the driver
    most_rows: int = 100_000
    most_triples: int = 1_000_000

    def __post_init__(self) -> None:
        if not 0 <= self.lenience <= 1:
            raise ValueError("lenience must lie between 0 and 1")
        if self.runs < 1 or self.seed_step < 1:
            raise ValueError("runs and seed_step are at least 1")

    @property
    def label(self) -> str:
        """Part of file names: mode, depth, model and lenience."""
        mode = "full" if self.depth is None else f"subgraph-d{max(1, self.depth)}"
        model = "".join(c if c.isalnum() else "-" for c in self.model.lower()).strip("-")
        return f"{mode}-{model}" + (f"-l{self.lenience:g}" if self.lenience else "")


@dataclass
class Context:
    name: str
    question: str
    query: str
    columns: list[str]
    gold: list[list[str]]
    seeds: list[str]
    text: str
    triples: int
    predicates: list[dict]
    subject_types: dict[str, int]
    object_types: dict[str, int]
    retrieval: str


def messages(question: str, context: str, columns: list[str]) -> list[dict]:
    ask = f"Context (sorted N-Triples):\n{context}\n\nQuestion: {question}\n\nReply with JSON only: columns, exactly {json.dumps(columns)}, and rows, one list of strings for each answer in that order. Write resources as IRIs of the context; leave unknown cells empty; give no rows without evidence."
    return [{"role": "system", "content": "Answer questions on a maintenance graph from the given triples alone, in the JSON form asked for."}, {"role": "user", "content": ask}]


def context_of(store, name: str, query: str, s: Settings) -> Context:
    """Gold rows and context of one question."""
    result = run(store, query, prefixes=s.prefixes)
    columns = result.columns
    rows = result.limit(s.most_rows + 1).collect()
    if len(rows) > s.most_rows:
        raise ValueError(f"{name} has more than {s.most_rows} gold rows")
    gold = [["" if v is None else str(v) for v in r] for r in rows]
    triples = store.triples()
    names = R.seed_names(query, s.base)
    extra = [r["seed"] for r in R.literal_seeds(triples, query, s.base).collect()]
    seeds = sorted({*names, *extra})
    if s.depth is None:
        sub = triples
    else:
        sub = R.khop(triples, triples.sparkSession.createDataFrame([(x,) for x in seeds], "n string"), s.depth)
    sub = sub.persist()
    try:
        size = sub.count()
        if size > s.most_triples:
            raise ValueError(f"the context of {name} has {size} triples, more than {s.most_triples}")
        kinds = R.term_types(sub).collect()
        counts = R.predicate_breakdown(sub).orderBy(F.col("predicate") == "__other__", F.desc("count"), "predicate").collect()
        by = lambda side: {r["term_type"]: r["count"] for r in sorted(kinds, key=lambda r: r["term_type"]) if r["position"] == side}
        text = stable_text(sub)
        return Context(name, question_of(query, name), query, columns, gold, [x.strip("<>") for x in seeds], text, size, [r.asDict() for r in counts], by("subject"), by("object"), R.retrieval_text(seeds, s.depth, "full" if s.depth is None else "subgraph"))
    finally:
        sub.unpersist()


def key_of(c: Context, s: Settings, seed: int | None = None) -> str:
    """Key of an answer: all that the reply depends on, as SHA-256 of sorted JSON."""
    payload = {"path": c.name, "question": c.question, "query": c.query, "context_hash": text_hash(c.text), "columns": c.columns, "depth": "full" if s.depth is None else str(s.depth), "model": s.model}
    if seed is not None:
        payload["seed"] = seed
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()


def find_cached(cache: dict, key: str, c: Context, fallback: bool) -> dict | None:
    """By key; with ``fallback`` else the entry of the same question, else one with the same columns, best with
    as many rows."""
    entry = cache.get(key)
    if entry is None and fallback:
        entries = [e for _, e in sorted(cache.items()) if isinstance(e, dict)]
        entry = next((e for e in entries if isinstance(e.get("_meta"), dict) and e["_meta"].get("path") == c.name), None)
        if entry is None:
            fit = [e for e in entries if e.get("columns") == c.columns]
            entry = next((e for e in fit if len(e.get("rows", [])) == len(c.gold)), fit[0] if fit else None)
    return None if entry is None else {"columns": entry.get("columns", []), "rows": entry.get("rows", [])}


def answer(c: Context, s: Settings, cache: dict, responder: Responder | None, seed: int | None) -> dict:
    key = key_of(c, s, seed)
    hit = find_cached(cache, key, c, s.cache_only or responder is None)
    if hit is not None:
        return hit
    if s.cache_only or responder is None:
        raise FileNotFoundError(f"no cached answer for {c.name}")
    from ..operators.prompts import unfence

    try:
        reply = json.loads(unfence(responder(messages(c.question, c.text, c.columns), seed or 0)))
    except json.JSONDecodeError:
        LOG.warning("the reply on %s is no JSON", c.name)
        reply = {}
    cache[key] = reply | {"_meta": {"path": c.name, "model": s.model}}
    return reply


def canonical_rows(store, rows: list[tuple[str, int, list[str]]], s: Settings) -> dict[tuple[str, int], list[str]]:
    """Canonical cells of (side, row, cells)."""
    triples = store.triples()
    flat = [(side, n, i, "" if v is None else str(v)) for side, n, cells in rows for i, v in enumerate(cells)]
    df = triples.sparkSession.createDataFrame(flat, "side string, n int, i int, v string")
    out: dict[tuple[str, int], dict[int, str]] = {(side, n): {} for side, n, _ in rows}
    for r in S.canonical(df, "v", S.unique_labels(triples), S.unique_local_names(triples), s.prefixes).collect():
        out[r["side"], r["n"]][r["i"]] = r["canonical"] or ""
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def score(store, c: Context, reply: dict, s: Settings) -> dict:
    """tp, fp, fn, precision, recall, f1 of one answer; rows of the wrong width are no answer."""
    columns = reply.get("columns") or []
    pred = [list(r)[: len(c.columns)] for r in reply.get("rows") or []] if len(columns) == len(c.columns) else []
    rows = [("gold", i, r) for i, r in enumerate(c.gold)] + [("pred", i, r) for i, r in enumerate(pred)]
    cells = canonical_rows(store, rows, s) if rows else {}
    side = lambda k, n: [cells[k, i] for i in range(n)]
    tp = S.greedy(side("gold", len(c.gold)), side("pred", len(pred)), S.mismatch_budget(len(c.columns), s.lenience))
    fp, fn = len(pred) - tp, len(c.gold) - tp
    if not c.gold and not pred:
        p = r = f1 = 1.0
    else:
        p = tp / (tp + fp) if tp + fp else 0.0
        r = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * p * r / (p + r) if p + r else 0.0
    return {"question": c.name, "tp": tp, "fp": fp, "fn": fn, "precision": p, "recall": r, "f1": f1}


def evaluate(store, queries: list[tuple[str, str]], s: Settings, cache: dict | None = None, responder: Responder | None = None) -> dict:
    """Scores of all questions over all runs, with means and sample deviations over the runs."""
    cache = {} if cache is None else cache
    contexts = [context_of(store, n, q, s) for n, q in queries]  # once, for all runs
    spark = store.spark
    scores, per_run = [], []
    for k in range(s.runs):
        seed = s.seed + k * s.seed_step if s.runs > 1 else None
        own = [score(store, c, answer(c, s, cache, responder, seed), s) | {"run": k} for c in contexts]
        scores += own
        df = spark.createDataFrame(own) if own else spark.createDataFrame([], "tp long, fp long, fn long, precision double, recall double, f1 double")
        per_run.append(S.macro_micro(df).first().asDict() | {"run": k})
    runs = spark.createDataFrame([{"metric": m, "value": float(r[m])} for r in per_run for m in r if m != "run"])
    summary = {r["metric"]: {"mean": r["mean"], "std": r["std"]} for r in S.mean_std(runs, "value", ["metric"]).collect()}
    return {"label": s.label, "questions": scores, "runs": per_run, "summary": summary}


def evaluation_markdown(result: dict) -> str:
    lines = [f"# Evaluation {result['label']}", "", "| metric | mean | deviation |", "| --- | ---: | ---: |"]
    lines += [f"| {m} | {v['mean']:.4f} | {v['std']:.4f} |" for m, v in sorted(result["summary"].items())]
    lines += ["", "| run | question | P | R | F1 | tp | fp | fn |", "| ---: | --- | ---: | ---: | ---: | ---: | ---: | ---: |"]
    lines += [f"| {q['run']} | {q['question']} | {q['precision']:.4f} | {q['recall']:.4f} | {q['f1']:.4f} | {q['tp']} | {q['fp']} | {q['fn']} |" for q in result["questions"]]
    return "\n".join(lines) + "\n"


def write_profiles(contexts: list[Context], folder: str) -> dict:
    """One context file for each question and a summary of what was retrieved."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    summary = {}
    for c in contexts:
        (root / f"{c.name.replace('/', '_')}.nt").write_text(c.text, encoding="utf-8")
        summary[c.name] = {"question": c.question, "seeds": c.seeds, "triple_count": c.triples, "predicate_breakdown": c.predicates, "subject_term_types": c.subject_types, "object_term_types": c.object_types, "retrieval_query": c.retrieval, "context_hash": text_hash(c.text)}
    save_json(summary, str(root / "summary.json"))
    return summary


def estimate_cost(contexts: list[Context], s: Settings, cache: dict, prompt_price: str | None, request_price: str | None) -> dict:
    """Tokens and cost of the requests that are not cached; null where the price is not known."""
    out = {"model": s.model, "requests": 0, "would_call": 0, "prompt_tokens": 0, "cost": None if prompt_price is None else "0"}
    total = Decimal(0)
    for c in contexts:
        for k in range(s.runs):
            out["requests"] += 1
            if key_of(c, s, s.seed + k * s.seed_step if s.runs > 1 else None) in cache:
                continue
            text = "".join(f"{m['role']}:{m['content']}\n" for m in messages(c.question, c.text, c.columns))
            tokens = max(1, len(text) // 4)
            out["would_call"] += 1
            out["prompt_tokens"] += tokens
            if prompt_price is not None:
                total += Decimal(prompt_price) * tokens + Decimal(request_price or "0")
    if prompt_price is not None:
        out["cost"] = format(total, "f")
    return out


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """A small graph as one Turtle file with prefixes, subjects in order."""

    def short(t: str) -> str:
        for p, ns in prefixes.items():
            local = t[1 + len(ns) : -1]
            if t.startswith(f"<{ns}") and local.replace("_", "").replace("-", "").isalnum():
                return f"{p}:{local}"
        return t

    lines = [f"@prefix {p}: <{ns}> ." for p, ns in prefixes.items()]
    last = None
    for r in triples.distinct().orderBy("s", "p", "o").toLocalIterator():
        if r["s"] != last:
            lines.append((" .\n" if last is not None else "") + f"\n{short(r['s'])} {short(r['p'])} {short(r['o'])}")
        else:
            lines[-1] += f" ;\n    {short(r['p'])} {short(r['o'])}"
        last = r["s"]
    Path(path).write_text("\n".join(lines) + (" .\n" if last is not None else "\n"), encoding="utf-8")
