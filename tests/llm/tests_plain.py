"""Plain versions of operators, taken from their own tests."""

from test_decontaminate import plain as _leaks
from test_simhash import plain as groups
from test_suffix import plain as repeats

from quarry.llm.tokens import tokenize

__all__ = ["groups", "leaks", "repeats", "tokenize"]


def leaks(docs, items, phrase):
    return _leaks([(d, t or "") for d, t in docs], [(k, t or "") for k, t in items], phrase)
