"""Word lists that the text functions take as a parameter, with small defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


@dataclass(frozen=True)
class Vocabulary:
    """Configuration of the text functions; any list can be replaced."""

    stop: tuple[str, ...] = _words("a an the this that these those his her their its my your our is are was were be been being am of in on at by to for with from and or but as it he she they we you i there here some any very")
    non_content: tuple[str, ...] = _words("image picture photo scene background foreground thing things something nothing none unknown")
    #: Beginnings of sentences that speak of a description itself (fixed values).
    remarks: tuple[str, ...] = ("given the description", "let's", "lets", "here is", "in summary", "to summarize", "overall, the image", "overall the image")
    people: tuple[str, ...] = _words("person people man men woman women boy girl child children adult baby group crowd couple")
    light_verbs: tuple[str, ...] = _words("be do have make take get go")
    prepositions: tuple[str, ...] = ("in front of", "on top of", "next to", "beside", "behind", "near", "between", "around", "above", "below", "under", "with", "against", "along")
    determiners: tuple[str, ...] = _words("the a an his her their")
    counts: tuple[tuple[str, int], ...] = (("zero", 0), ("no", 0), ("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("six", 6), ("seven", 7), ("eight", 8), ("nine", 9), ("ten", 10), ("several", 3), ("few", 3), ("many", 6), ("dozen", 12))
    leading_counts: tuple[str, ...] = _words("one two three four five several some many")
    irregular: tuple[tuple[str, str], ...] = field(default=(("men", "man"), ("women", "woman"), ("children", "child"), ("people", "person"), ("feet", "foot"), ("sitting", "sit"), ("running", "run"), ("shaking", "shake"), ("smiling", "smile"), ("holding", "hold"), ("sat", "sit"), ("held", "hold"), ("gave", "give")))


DEFAULT = Vocabulary()
