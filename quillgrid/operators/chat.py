"""Grounded chat over a context (C5-C7, T13): the provider is any callable; everything else is data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

Turns = list[dict[str, str]]


def build_turns(question: str, context: str, history: Turns) -> Turns:
    """F22 on the driver."""
    # The wording of the turn.
    lead = "Use the following retrieved context to answer the question."
    nothing = "(No relevant context was retrieved.)"
    return [*history, {"role": "user", "content": f"{lead}\n\nContext:\n{context or nothing}\n\nQuestion:\n{question.strip()}"}]


def citations(answer: str, available: dict[int, Any]) -> list[Any]:
    """What the answer cites of the context, by number."""
    import re

    return [available[n] for n in sorted({int(x) for x in re.findall(r"\[(\d+)]", answer)}) if n in available]


def ask(question: str, context: str, available: dict[int, Any], history: Turns, generate: Callable[[Turns], str], store: Callable[[str, str, list], None]) -> dict[str, Any]:
    """The user's turn is stored before the answer is made, and stays if that fails; an empty answer is an error."""
    if not question.strip():
        raise ValueError("question must not be blank")
    store("user", question, [])
    answer = generate(build_turns(question, context, history)).strip()
    if not answer:
        raise RuntimeError("the chat provider returned an empty answer")
    found = citations(answer, available)
    store("assistant", answer, found)
    return {"answer": answer, "citations": found}


def stream(question: str, context: str, available: dict[int, Any], history: Turns, deltas: Callable[[Turns], Iterator[str]], store: Callable[[str, str, list], None]) -> Iterator[tuple[str, Any]]:
    """Metadata, a delta for each part, done with the citations; error in place of what fails."""
    store("user", question, [])
    yield "metadata", {"citations_available": sorted(available)}
    parts: list[str] = []
    try:
        for part in deltas(build_turns(question, context, history)):
            parts.append(part)
            yield "delta", part
        answer = "".join(parts).strip()
        if not answer:
            raise RuntimeError("the chat provider returned an empty answer")
    except Exception as problem:
        yield "error", str(problem)
        return
    found = citations(answer, available)
    store("assistant", answer, found)
    yield "done", {"answer": answer, "citations": found}
