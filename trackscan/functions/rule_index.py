"""Rule tables of any size against texts: an index of grams, met by equality.

Each rule has a plain text that a match can't do without. The index holds pieces of it, of eight or
four characters, that cover it from end to end. A text gives out only those of its own pieces that a
bitmap of the index knows, with their positions; pieces meet by equality, and a rule's text stands
where all its pieces do, one behind the other. No text is in that join, and the rules are neither
collected nor broadcast by this module; the bitmap has a bounded size.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.functions.match import IGNORE_CASE, fold

LONG, SHORT = 8, 4
#: Characters of a text whose pieces are one array.
BLOCK = 1 << 15
#: Bits of a bitmap for each piece of the index, and at most.
BITS_PER_GRAM, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 22
#: Rules without four plain characters in a row have to be run on every text.
MOST_EVERYWHERE = 1_000

_PLAIN = r"^(?:[^\\.^$*+?{}\[\]|()]|\\[^\p{L}\p{N}])*$"
_BETWEEN = r"\\[sSdDwW][*+?]*|(?<!\\)\[[^\]]*\][*+?]*|(?<!\\)\.[*+?]*"


def is_plain(pattern: Column) -> Column:
    """Whether a pattern is plain ASCII text, but for escaped marks."""
    return pattern.rlike(_PLAIN) & (F.length(pattern) == F.octet_length(pattern))


def _unescaped(pattern: Column) -> Column:
    return F.lower(F.regexp_replace(pattern, r"\\(.)", "$1"))


def needle(pattern: Column) -> Column:
    """The longest plain text that every match of a pattern holds, or null if none is certain."""
    pieces = F.filter(F.split(pattern, _BETWEEN), lambda p: p != "")
    simple = ~pattern.rlike(r"[|{]|\(\?|(?<!\\)\(") & F.forall(pieces, is_plain)
    longest = F.reduce(
        pieces, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a)
    )
    return F.when(is_plain(pattern), _unescaped(pattern)).when(
        simple & (longest != ""), _unescaped(longest)
    )


def grams_of(rules: DataFrame) -> DataFrame:
    """Rows (rule, family, gram, off, n) of rules (rule, needle, folded): n pieces of each text."""
    size = F.when(F.length("needle") >= LONG, LONG).otherwise(SHORT)
    last = F.length("needle") - size
    offs = F.array_distinct(F.concat(F.sequence(F.lit(0), last, size), F.array(last)))
    return (
        rules.filter(F.length("needle") >= SHORT)
        .withColumn("size", size)
        .withColumn("offs", offs)
        .select(
            "rule",
            F.concat(F.when(F.col("folded"), "folded").otherwise("raw"), F.col("size")).alias("family"),
            "needle",
            "size",
            F.size("offs").alias("n"),
            F.explode("offs").alias("off"),
        )
        .select("rule", "family", F.expr("substring(needle, off + 1, size)").alias("gram"), "off", "n")
    )


class Bitmap:
    """The pieces of one family as bits of a constant array."""

    def __init__(self, grams: DataFrame, n: int) -> None:
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_GRAM * n - 1).bit_length()))
        place = self._place(F.col("gram"))
        rows = (
            grams.groupBy(F.bitmap_bucket_number(place + 1).alias("part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("some"))
            .collect()  # MOST_BITS at most, however many rules there are
        )
        held = bytearray(self.bits // 8)
        for row in rows:
            first = (row["part"] - 1) * len(row["some"])
            held[first : first + len(row["some"])] = row["some"]
        words = [int.from_bytes(held[i : i + 8], "little", signed=True) for i in range(0, len(held), 8)]
        self.words = F.from_json(F.lit(json.dumps(words)), "array<bigint>")

    def _place(self, gram: Column) -> Column:
        return F.xxhash64(gram).bitwiseAND(F.lit(self.bits - 1))

    def knows(self, gram: Column) -> Column:
        place = self._place(gram)
        word = F.get(self.words, F.shiftright(place, 6).cast("int"))
        return F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1


def found(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (text_key, rule), each once: texts (text_key, text) that hold the needle of a rule.

    rules: (rule, needle, folded); a folded needle is looked for whatever the case, any other as it
    stands. Needles of fewer than SHORT characters are not found here. Null texts hold nothing.
    """
    index = grams_of(rules)
    sizes = {r["family"]: r["count"] for r in index.groupBy("family").count().collect()}
    blocks = texts.filter("text IS NOT NULL")
    parts = []
    for folded in (True, False):
        mine = {f"{'folded' if folded else 'raw'}{k}": k for k in (LONG, SHORT)}
        mine = {f: k for f, k in mine.items() if sizes.get(f)}
        if not mine:
            continue
        whole = fold(F.col("text")) if folded else F.col("text")
        cut = rf"(?s)(?=(.{{1,{BLOCK + LONG - 1}}})).{{1,{BLOCK}}}"
        block = blocks.select(
            "text_key", F.posexplode(F.regexp_extract_all(whole, F.lit(cut), F.lit(1))).alias("no", "block")
        )
        # Pieces of both lengths begin at the same places: a text is cut up once for the two.
        own = F.regexp_extract_all("block", F.lit(rf"(?s)(?=(.{{{min(mine.values())},{max(mine.values())}}}))."), F.lit(1))
        piece = block.select("text_key", "no", F.posexplode(own).alias("at", "piece"))
        known, grams = [], []
        for family, k in mine.items():
            bitmap = Bitmap(index.filter(F.col("family") == family), sizes[family])
            gram = F.substring("piece", 1, k)
            there = bitmap.knows(gram)
            known.append(there)
            grams.append(F.when(there, F.struct(F.lit(family).alias("family"), gram.alias("gram"))))
        parts.append(
            piece.filter((F.col("at") < BLOCK) & reduce(Column.__or__, known)).select(
                "text_key",
                (F.col("no").cast("long") * BLOCK + F.col("at")).alias("at"),
                F.inline(F.array_compact(F.array(*grams))),
            ).select("text_key", "family", "gram", "at")
        )
    if not parts:
        return texts.join(rules, F.lit(False)).select("text_key", "rule")
    return (
        reduce(DataFrame.union, parts)
        .join(index, ["family", "gram"])
        .groupBy("text_key", "rule", (F.col("at") - F.col("off")).alias("start"))
        .agg(F.count("*").alias("there"), F.max("n").alias("n"))
        .filter("there = n")
        .select("text_key", "rule")
        .distinct()
    )


def matches(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (text_key, rule), each once: texts that a rule's pattern, or plain host, occurs in.

    rules: (rule, pattern, is_host). A host counts in the case in which it is listed, a pattern in
    any. A pattern that isn't plain text runs only on texts that hold the text it needs: these meet
    it by the key of the text, and are the only texts in a join. Up to MOST_EVERYWHERE rules may
    need no text of SHORT characters; they run on every text, and more are an error.
    """
    host = F.col("is_host")
    named = rules.filter("pattern IS NOT NULL").select(
        "rule",
        "pattern",
        F.when(host, F.col("pattern")).otherwise(needle(F.col("pattern"))).alias("needle"),
        (~host).alias("folded"),
        (host | is_plain(F.col("pattern"))).alias("plain"),
    )
    everywhere = F.coalesce(F.length("needle"), F.lit(0)) < SHORT
    few = named.filter(everywhere).orderBy("rule").limit(MOST_EVERYWHERE + 1).collect()
    if len(few) > MOST_EVERYWHERE:
        raise ValueError(f"more than {MOST_EVERYWHERE} rules without {SHORT} plain characters in a row")
    hits = found(texts, named.select("rule", "needle", "folded"))
    both = hits.join(named.select("rule", "pattern", "plain"), "rule")
    out = [both.filter("plain").select("text_key", "rule")]
    if named.filter(~F.col("plain") & ~everywhere).limit(1).count():
        needed = both.filter("NOT plain").select("text_key", "rule", "pattern")
        holds = F.expr(f"rlike(text, concat('{IGNORE_CASE}', pattern))")
        out.append(texts.join(needed, "text_key").filter(holds).select("text_key", "rule"))
    if few:
        text = F.col("text")
        tried = [
            F.when(text.contains(r["pattern"]) if not r["folded"] else text.rlike(IGNORE_CASE + r["pattern"]), F.lit(r["rule"]))
            for r in few
        ]
        out.append(
            texts.filter("text IS NOT NULL").select(
                "text_key", F.explode(F.array_compact(F.array(*tried))).alias("rule")
            )
        )
    return reduce(DataFrame.union, out)
