"""A question answered by a loop of plan, act and judge, on the driver; the
model is a callable from prompt to text."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from codeweft.plans.tools import Toolbox, highlighted

MAX_STEPS = 3
_PLAN_CHARS, _JUDGE_CHARS, _SHORT = 3000, 4000, 40


def extract_json(text: str) -> dict:
    """The first JSON object in ``text``; an empty one without any."""
    decoder = json.JSONDecoder()
    for at, c in enumerate(text):
        if c == "{":
            try:
                found, _ = decoder.raw_decode(text[at:])
            except ValueError:
                continue
            if isinstance(found, dict):
                return found
    return {}


def run_id(question: str, now: float | None = None) -> str:
    stamp = time.strftime("%Y%m%d-%H%M%S", time.gmtime(now))
    return f"{stamp}-{hashlib.sha256(question.encode()).hexdigest()[:6]}"


@dataclass
class Answer:
    answer: str
    trace: list[dict] = field(default_factory=list)
    is_partial: bool = False
    highlighted_nodes: list[str] = field(default_factory=list)


def _results(calls: list[dict], most: int) -> str:
    return "\n".join(f"{c['tool']}({json.dumps(c['args'])}): {json.dumps(c['result'], default=str)[:most]}" for c in calls)


def run_agent(question: str, tools: Toolbox, model: Callable[[str], str], repo_id: str = "", log_dir: str | None = None) -> Answer:
    """Up to MAX_STEPS rounds; an unfinished answer after the last is partial."""
    registry, calls, answer, complete = tools.registry(), [], "", False
    log = Path(log_dir) / run_id(question) if log_dir else None
    begin = time.perf_counter()

    def keep(name: str, state: dict) -> None:
        if log:
            log.mkdir(parents=True, exist_ok=True)
            (log / name).write_text(json.dumps(state, default=str))

    for step in range(MAX_STEPS):
        plan = extract_json(model(f"Tools: {', '.join(registry)}. Reply with JSON {{tool, args}}.\nQuestion: {question}\nSo far:\n{_results(calls, _PLAN_CHARS)}"))
        name, args = plan.get("tool", ""), plan.get("args") if isinstance(plan.get("args"), dict) else {}
        args = args | ({"repo_id": repo_id} if repo_id else {})
        try:
            result = registry[name](args) if name in registry else {"error": f"unknown tool {name!r}"}
        except Exception as error:  # noqa: BLE001  a tool's error is a result
            result = {"error": str(error).split("\n")[0]}
        calls.append({"tool": name, "args": args, "result": result})
        keep(f"{step}_execute.json", calls[-1])
        verdict = extract_json(judged := model(f"Answer with JSON {{complete, answer}}.\nQuestion: {question}\nResults:\n{_results(calls, _JUDGE_CHARS)}"))
        answer = str(verdict.get("answer", judged if not verdict else ""))
        complete = bool(verdict.get("complete"))
        keep(f"{step}_judge.json", {"answer": answer, "complete": complete})
        if complete:
            break
    if len(answer) < _SHORT or answer.lstrip().startswith("{"):
        again = model(f"Write the answer in full sentences.\nQuestion: {question}\nResults:\n{_results(calls, _JUDGE_CHARS)}").strip()
        answer = again or answer
    out = Answer(answer, [{"tool": c["tool"], "args": json.dumps(c["args"])} for c in calls], not complete, highlighted(calls))
    keep("final.json", {"answer": answer, "is_partial": out.is_partial, "seconds": time.perf_counter() - begin})
    return out
