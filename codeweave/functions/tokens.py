"""Patterns put together from tokens of a language: white space may stand between any two of them.

Java's regular expressions, as Spark's functions take them. A token is a piece of pattern; ``keep`` makes it a group.
"""

from __future__ import annotations

#: An identifier of the C family, a text in quotes of one kind (its body is a group), and type arguments.
NAME = r"[A-Za-z_$][\w$]*"
QUOTED = r"(?:'([^']*)'|\"([^\"]*)\"|`([^`]*)`)"
TYPE_ARGUMENTS = r"<[^<>()]*(?:<[^<>()]*>[^<>()]*)*>"
OPEN, CLOSE, DOT = r"\(", r"\)", r"\."


def seq(*tokens: str) -> str:
    return r"\s*".join(tokens)


def line(*tokens: str) -> str:
    """A sequence at the start of a line."""
    return r"^\s*" + seq(*tokens)


def any_of(*words: str) -> str:
    """One of some words, the longest that fits."""
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + r")\b"


def keep(token: str) -> str:
    return f"({token})"


def maybe(*tokens: str) -> str:
    """A sequence that may be missing, with the white space after it."""
    return rf"(?:{seq(*tokens)}\s*)?"


def apart(*tokens: str) -> str:
    """Tokens with white space between each two, which there must be."""
    return r"\s+".join(tokens)


def either(*ways: str) -> str:
    return "(?:" + "|".join(ways) + ")"
