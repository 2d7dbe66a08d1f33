"""Keyword tokens and the default token-length estimate."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the keyword index.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should "
    "may might shall can to of in for on with at by from as into through during before after "
    "and but or nor not so yet both either neither each every all any few more most other some "
    "such no only own same than too very just about above also it its this that these those i "
    "me my we our you your he him his she her they them their what which who whom how when "
    "where why"
).split()

PUNCTUATION = string.punctuation

# Every character Python's str.split() treats as white space.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def words(text: Column) -> Column:
    """White-space separated pieces, without empty ones."""
    spaced = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def keyword_tokens(text: Column) -> Column:
    """Lower-case, drop ASCII punctuation, split on white space, drop stop words and single characters."""
    plain = F.translate(F.lower(text), WHITESPACE + PUNCTUATION, " " * len(WHITESPACE))
    return F.filter(F.split(plain, " "), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def keyword_tokens_of(text: str) -> list[str]:
    """The same rule for one question on the driver."""
    plain = text.lower().translate(str.maketrans("", "", PUNCTUATION))
    return [t for t in plain.split() if len(t) > 1 and t not in STOP_WORDS]


def token_estimate(text: Column) -> Column:
    """Four tokens for every three words, rounded up."""
    return F.ceil(F.size(words(text)) * F.lit(4) / F.lit(3)).cast("int")
