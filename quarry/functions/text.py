"""Text expressions: case folding, tokenizers, filters and markup. All are built-in Spark expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent English words that are left out of an index if asked for.
STOP_WORDS = tuple(
    """A ABOUT ABOVE AFTER AGAIN AGAINST ALL AM AN AND ANY ARE AS AT BE BECAUSE BEEN BEFORE BEING BELOW BETWEEN BOTH BUT BY CAN DID
    DO DOES DOING DON DOWN DURING EACH FEW FOR FROM FURTHER HAD HAS HAVE HAVING HE HER HERE HERS HERSELF HIM HIMSELF HIS HOW I IF
    IN INTO IS IT ITS ITSELF JUST ME MORE MOST MY MYSELF NO NOR NOT NOW OF OFF ON ONCE ONLY OR OTHER OUR OURS OURSELVES OUT OVER
    OWN S SAME SHE SHOULD SO SOME SUCH T THAN THAT THE THEIR THEIRS THEM THEMSELVES THEN THERE THESE THEY THIS THOSE THROUGH TO
    TOO UNDER UNTIL UP VERY WAS WE WERE WHAT WHEN WHERE WHICH WHILE WHO WHOM WHY WILL WITH YOU YOUR YOURS YOURSELF YOURSELVES""".split()
)
#: What ends a word: every ASCII sign that is neither letter nor digit.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"
NOT_SKETCH = r"[ .\-/+=&]+"


def ascii_upper(text: Column) -> Column:
    """Upper case of ASCII letters; others stay, so that every engine folds alike. Null becomes empty."""
    return _upper(F.coalesce(text.cast("string"), F.lit("")))


def _upper(text: Column) -> Column:
    """translate() goes letter by letter; upper() doesn't, but folds all letters."""
    return F.when(_is_ascii(text), F.upper(text)).otherwise(F.translate(text, string.ascii_lowercase, string.ascii_uppercase))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _parts(text: Column, signs: str) -> Column:
    """Upper-cased parts between signs, none of which is a letter; of a text with other than ASCII characters only the parts with such are folded letter by letter."""
    filled = F.coalesce(text.cast("string"), F.lit(""))
    parts = F.when(_is_ascii(filled), F.split(F.upper(filled), signs, -1)).otherwise(F.transform(F.split(filled, signs, -1), _upper))
    return F.filter(parts, lambda x: x != "")


def space_tokens(text: Column) -> Column:
    """Upper-cased tokens between blanks; line ends and punctuation stay in them."""
    return _parts(text, " ")


def alnum_tokens(text: Column) -> Column:
    """Upper-cased runs of ASCII letters and digits and of all other than ASCII characters."""
    return _parts(text, NOT_ALNUM)


def sketch_tokens(text: Column) -> Column:
    """Upper-cased tokens between blanks and the signs . - / + = &"""
    return _parts(text, NOT_SKETCH)


TOKENIZERS = {"space": space_tokens, "alnum": alnum_tokens, "sketch": sketch_tokens}


def tokens(text: Column, tokenizer: str = "space") -> Column:
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"tokenizers are {', '.join(TOKENIZERS)}")
    return TOKENIZERS[tokenizer](text)


def is_valid(term: Column) -> Column:
    """A term of more than a byte, or one ASCII letter or digit."""
    return (F.octet_length(term) > 1) | term.rlike("^[A-Z0-9]$")


def split_long(term: Column, limit: int) -> Column:
    """Pieces of a long term, of so many characters each but the last."""
    count = F.ceil(F.length(term) / limit).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(term, i * limit + 1, F.lit(limit)))


def clean(text: Column) -> Column:
    """ASCII letters, digits and single white space only."""
    return F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9\s]", ""), r"\s+", " ")


def query_fields(query: Column) -> Column:
    """Map of field to text of a query string as A=x+y&B=z: upper-cased, + stands for a blank. No escapes are resolved; of a repeated field the last counts."""
    pairs = F.filter(F.split(F.translate(ascii_upper(query), "+", " "), "&"), lambda x: x.contains("="))
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.expr("1").alias("one"), x.alias("pair")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["pair"]
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.substring(last(k), F.length(k) + 2, F.lit(1 << 30))))


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def highlight(text: Column, query: str, most: int = 6) -> Column:
    """The text with HTML signs escaped and the query's first words, of those with a letter or digit, marked in any case."""
    words = [w for w in query.split() if any(c.isascii() and c.isalnum() for c in w)][:most]
    escaped = escape_html(text)
    if not words:
        return escaped
    special = set(r"\.^$|?*+()[]{}")
    pattern = "|".join("".join("\\" + c if c in special else c for c in w) for w in words)
    return F.regexp_replace(escaped, f"(?i)({pattern})", '<span class="highlight">$1</span>')
