"""Personal data by patterns, and by contexts that are learned from what the patterns found.

The fixed kinds (email, ip, card, phone) come from regular expressions. Their finds are the seeds of a bootstrap.
Its patterns are the two words before a token, the two after it, and both around one to four tokens. In each turn the
patterns are made anew from everywhere that the values believed so far stand, and need several different ones, so a
chance neighbour teaches nothing. A pattern's confidence is the share of *all* its occurrences in the corpus that
hold something believed. What stands in a reliable pattern is believed as far as its best pattern is; a value
without a digit, or shorter than six characters, only as far as it stands in such places and not elsewhere, so common
words are not. New values make new patterns, until a turn changes nothing. What is believed then gets the kind of its best pattern, and is
added wherever it stands in a reliable one. Patterns are counted before their places are listed: those whose share
among the texts that hold something believed is too small already are dropped by one aggregation of word pairs.

Everything is DataFrame functions. Positions are code points, ends exclusive. The regular expressions
are written with possessive repeats, which match the same and stay linear on long runs of one kind of character.

Edge cases: a null text counts as empty; repeated rows each get their spans; a null id is kept; an empty table
gives no rows. Columns of ``docs`` named like the result's columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideview.llm.shared import aside, keep, small

#: Kinds in the order in which they are listed at equal starts.
KINDS = ("email", "ip", "card", "phone")

# fixed values: the kinds' patterns
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]++"
OPENING, CLOSING = "([{<\x22\x27", ".,;:!?)]}>\x22\x27"
#: White space, and what stands for it inside a base span.
BLANKS, GLUE = "\x20\x09\x0a\x0b\x0c\x0d", "\ue000"

#: What each base span has in it.
SEEDS = "[0-9@]"

#: Different values that a pattern needs, and its least confidence.
SUPPORT, CONFIDENCE = 5, 0.6
#: How many tokens on a place is from where it is looked up: from the words before it, from those after it, from its own value.
STEPS = {"left": 2, "right": -1, "one": 0, "more": 0}
#: Tokens that a slot between two contexts holds at most.
SLOT = 4


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, by what lies between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    return F.when(
        F.size(found) > 0,
        F.aggregate(
            F.arrays_zip(found.alias("value"), F.slice(gaps, 1, F.size(found)).alias("gap")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out")),
            lambda acc, m: F.struct(
                (acc["at"] + m["gap"] + F.char_length(m["value"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + F.char_length(m["value"])).alias("end"), m["value"].alias("value")))).alias("out"),
            ),
            lambda acc: acc["out"],
        ),
    ).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.split(_digits(value), ""))
    single = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2).cast("int") % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(single, F.lit(0), lambda a, d: a + d) % 10 == 0


def _fit(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.char_length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        return F.when(F.char_length(_digits(value)).between(14, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(value)).between(10, 15)
    return F.lit(True)


def _checked(rank: int, kind: str) -> Column:
    """The matches of a kind that pass its test, as spans."""
    return F.transform(
        F.filter(f"_{kind}", lambda m: _fit(kind, m["value"])),
        lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")),
    )


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``: array<struct<start, rank, end, kind, value>> in order of start and kind."""
    text = F.coalesce("text", F.lit(""))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    out = docs.withColumn("_digit", text.rlike("[0-9]")).withColumns(
        {
            "_email": F.when(F.instr(text, "@") > 0, located(text, EMAIL)).otherwise(empty),
            "_ip": F.when(F.col("_digit") & text.rlike(r"[0-9]\.[0-9]"), located(text, IP)).otherwise(empty),
            "_card": F.when(F.col("_digit"), located(text, CARD)).otherwise(empty),
            "_phone": F.when(F.col("_digit") & (F.instr(text, "+") > 0), located(text, PHONE)).otherwise(empty),
        }
    )
    each = [_checked(rank, kind) for rank, kind in enumerate(KINDS)]
    return out.withColumn("base", F.array_sort(F.concat(*each))).drop("_digit", *(f"_{k}" for k in KINDS))


def _core(token: Column) -> Column:
    """A token without the marks around it."""
    return F.rtrim(F.ltrim(token, F.lit(OPENING)), F.lit(CLOSING))


def _glued(text: Column) -> Column:
    """``text`` with the white space inside base spans replaced, character by character, so that each span is one token."""
    spaced = F.filter("base", lambda b: b["value"].rlike(SPACE))
    return F.aggregate(spaced, text, lambda acc, b: F.overlay(acc, F.translate(b["value"], BLANKS, GLUE * len(BLANKS)), b["start"] + 1, b["end"] - b["start"]))


def _words(texts: DataFrame) -> DataFrame:
    """(doc_id, mark, w, low, i): one row for each token of ``glued``, i its place among them; low are they in small letters, with each digit as 0."""
    low = F.when(F.col("glued").rlike("[1-9]"), F.translate(F.lower("glued"), "123456789", "0" * 9)).otherwise(F.lower("glued"))
    some = texts.select("doc_id", "mark", *(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias(n) for t, n in ((F.col("glued"), "w"), (low, "low"))))
    # the places come from a sequence: before an explode of the words themselves the optimizer lists them twice more, to leave out texts without any
    return some.select("doc_id", "mark", "w", "low", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))).alias("i"))


def _at(name: str, step: int) -> Column:
    """The word so many places on."""
    return F.get(name, F.col("i") + step)


def _around() -> list[Column]:
    """doc_id, mark, i, before, held, after of a token: two words before, cores of up to SLOT tokens, words after the first; null beyond the ends."""
    return [
        *(F.col(c) for c in ("doc_id", "mark", "i")),
        F.when(F.col("i") > 1, F.concat_ws(" ", _at("low", -2), _at("low", -1))).alias("before"),
        F.array(*(_core(_at("w", j)) for j in range(SLOT))).alias("held"),
        F.array(*(_at("low", j) for j in range(1, SLOT + 2))).alias("after"),
    ]


def _near(texts: DataFrame, key: Column, hashes: DataFrame, only: Column | None = None, second: tuple[Column, DataFrame] | None = None) -> DataFrame:
    """The tokens of ``_around`` with ``kind``, one of STEPS: so far from each token whose key is in ``hashes`` (hash, kind).

    Tokens are looked up by hash alone in a table that goes to all tasks, and a token's surroundings are put together only
    where it fits and, of kind ``more``, another key is in a table too. With more hashes than may go there the surroundings
    cross a shuffle.
    """
    rows = _words(texts) if only is None else _words(texts).where(only)
    hashes = hashes.toDF("_key", "kind").distinct()
    step = F.coalesce(*(F.when(F.col("kind") == k, n) for k, n in STEPS.items()))
    within = F.col("i").between(0, F.size("w") - 1)
    if not (small(hashes) and (second is None or small(second[1]))):
        kinds = [r.kind for r in hashes.select("kind").distinct().collect()]
        rows = rows.select("*", key.alias("_key"), F.explode(F.array(*(F.lit(k) for k in kinds))).alias("kind"))
        return rows.withColumn("i", F.col("i") + step).where(within).select(*_around(), "_key", "kind").join(hashes, ["_key", "kind"], "left_semi").drop("_key")
    rows = rows.select("doc_id", "mark", "i", "w", "low", key.alias("_key")).join(F.broadcast(hashes), "_key")
    if second is not None:
        rows = rows.withColumn("_next", F.when(F.col("kind") == "more", second[0]))
        rows = rows.join(F.broadcast(second[1].toDF("_of").distinct()), F.col("_next") == F.col("_of"), "left").where("kind <> 'more' OR _of IS NOT NULL")
    return rows.withColumn("i", F.col("i") + step).where(within).select(*_around(), "kind")


def _right(width: int) -> Column:
    """The two words after a slot of ``width`` tokens, null where there are not two."""
    first, second = F.get("after", F.lit(width - 1)), F.get("after", F.lit(width))
    return F.when(second.isNotNull(), F.concat_ws(" ", first, second))


def _value(width: int) -> Column:
    if width == 1:
        return F.get("held", F.lit(0))
    return F.array_join(F.slice("held", 1, width), " ")


def _slots(side: str) -> Column:
    """The patterns of a place as struct<pattern, value, width>; only those that begin with the words before, or only the other one."""
    frame = lambda w: F.concat(F.lit("B "), F.col("before"), F.lit(" _ "), _right(w))
    names = [(F.concat(F.lit("L "), F.col("before")), 1), *((frame(w), w) for w in range(1, SLOT + 1))] if side == "left" else [(F.concat(F.lit("R "), _right(1)), 1)]
    return F.filter(F.array(*(F.struct(n.alias("pattern"), _value(w).alias("value"), F.lit(w).alias("width")) for n, w in names)), lambda x: x["pattern"].isNotNull())


def _side(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if small(table, 200_000) else table


def _places(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, mark, i, pattern, value, width) of all places where ``patterns`` (pattern) stand."""
    pair = lambda text: F.xxhash64(F.split(text, " ")[0], F.get(F.split(text, " "), F.lit(1)))
    left = patterns.where("pattern NOT LIKE 'R %'").select(pair(F.expr("split(substring(pattern, 3), ' _ ')[0]")), F.lit("left"))
    right = patterns.where("pattern LIKE 'R %'").select(pair(F.expr("substring(pattern, 3)")), F.lit("right"))
    near = _near(texts, F.xxhash64(_at("low", 0), _at("low", 1)), left.union(right))
    none = F.array().cast("array<struct<pattern:string,value:string,width:int>>")
    both = F.concat(*(F.when(F.col("kind") == side, _slots(side)).otherwise(none) for side in ("left", "right")))
    found = near.select("doc_id", "mark", "i", F.inline(both)).where("value <> ''")
    return found.join(_side(patterns.select("pattern")), "pattern", "left_semi")


def _where(texts: DataFrame, values: DataFrame, only: Column | None = None) -> DataFrame:
    """The tokens at which ``values`` (value) begin, with the value and its width; ``only``: a test that each value's first token passes."""
    parts = F.split("value", " ")
    wanted = values.select("value", F.size(parts).alias("width"))
    core = lambda j: _core(_at("w", j))
    one, longer = wanted.where("width = 1").select(F.xxhash64("value"), F.lit("one")), wanted.where("width > 1")
    if longer.isEmpty():
        place, widths = _near(texts, F.xxhash64(core(0)), one, only), 1
    else:
        more = longer.select(F.xxhash64(parts[0]), F.lit("more"))
        place, widths = _near(texts, F.xxhash64(core(0)), one.union(more), only, (F.xxhash64(core(0), core(1)), longer.select(F.xxhash64(parts[0], F.get(parts, F.lit(1)))))), SLOT
    of_width = lambda *widths: F.array(*(F.struct(_value(w).alias("value"), F.lit(w).alias("width")) for w in widths))
    fits = of_width(1) if widths == 1 else F.when(F.col("kind") == "one", of_width(1)).otherwise(of_width(*range(2, SLOT + 1)))
    return place.select("doc_id", "mark", "i", "before", "held", "after", F.inline(fits)).join(_side(wanted), ["value", "width"])


def _induced(found: DataFrame, support: int) -> DataFrame:
    """(pattern, believed): what stands around ``support`` different values or more, and the sum of their beliefs there."""
    of_width = lambda p: F.filter(F.concat(_slots("left"), _slots("right")), lambda x: (x["width"] == F.col("width")) & (x["value"] == F.col("value")))
    near = found.select("value", "belief", F.explode(of_width(found)["pattern"]).alias("pattern"))
    each = near.groupBy("pattern", "value").agg(F.sum("belief").alias("believed"))
    return each.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("believed").alias("believed")).where(F.col("n") >= support).drop("n")


def _neighbours(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, followed, preceded): how often each of ``pairs`` of words in a row stands before a token, and after one."""
    full = lambda j: F.when(_core(_at("w", j)) != "", 1).otherwise(0)
    rows = _words(texts).where(F.col("i") < F.size("w") - 1).withColumn("pair", F.xxhash64(_at("low", 0), _at("low", 1)))
    if small(pairs):
        rows = rows.join(F.broadcast(pairs), "pair", "left_semi")
    return rows.groupBy("pair").agg(F.sum(full(2)).alias("followed"), F.sum(full(-1)).alias("preceded"))


def _hopeful(patterns: DataFrame, held: DataFrame, confidence: float) -> DataFrame:
    """(pattern): those of ``patterns`` that can still be reliable.

    ``held`` are the texts that hold something believed. A pattern's places there are a part of all its places and have all
    its believed ones, so their share bounds its confidence from above. One aggregation of the patterns' word pairs counts
    them before any place is listed, and no pattern is lost by it.
    """
    words = F.split(F.expr("substring(pattern, 3)"), " ")
    sides = patterns.where("pattern NOT LIKE 'B %'").withColumn("pair", F.xxhash64(words[0], words[1]))
    counted = sides.join(_neighbours(held, sides.select("pair").distinct()), "pair", "left")
    places = F.coalesce(F.when(F.col("pattern").startswith("L "), F.col("followed")).otherwise(F.col("preceded")), F.lit(0))
    open_ones = counted.where(F.col("believed") >= confidence * (places + 1) - 1e-6).select("pattern")
    return open_ones.unionByName(patterns.where("pattern LIKE 'B %'").select("pattern"))


def _marked(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of ``texts`` whose mark is among ``marks`` (mark)."""
    marks = marks.distinct()
    return texts.join(F.broadcast(marks) if small(marks) else marks, "mark", "left_semi")


def _holding(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The texts that have a base span, or in which something was found."""
    return texts.where("seeded").unionByName(_marked(texts.where("NOT seeded"), keep(found.select("mark").distinct(), "holding")))


def _without(table: DataFrame, known: DataFrame | None, column: str) -> DataFrame:
    """(column): what ``table`` has there and ``known`` has not."""
    fresh = table.select(column).distinct()
    return keep(fresh if known is None else fresh.join(known.select(column), column, "left_anti"), "fresh")


def _with(table: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if table is None else table.unionByName(more)


def learned(texts: DataFrame, seeds: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame | None:
    """(pattern, value, kind) that the bootstrap believes beyond ``seeds`` (value, kind); None where nothing was learned.

    Each turn starts from all values believed so far and ends when a turn changes no belief. Beliefs only grow, in steps of a thousandth.
    """
    seeds = keep(seeds, "seeds")
    believed, mark = seeds.select("value", "kind", F.lit(1.0).alias("belief")), None
    # what a value or pattern once looked for has given holds for all turns, so each goes through the texts only once
    places, listed_ones, totals, located = None, None, None, None
    marks = F.get("w", F.col("i")).rlike(SEEDS)
    found = keep(_where(texts.where("seeded"), seeds, marks).drop("i"), "found")
    while True:
        induced = keep(_induced(found.join(_side(believed.select("value", "belief")), "value"), support), "induced")
        if induced.isEmpty():
            return None
        patterns = keep(_hopeful(induced, texts.where("seeded") if mark is None else _holding(texts, found), confidence), "patterns")
        if patterns.isEmpty():
            return None
        fresh = _without(patterns, listed_ones, "pattern")
        if not fresh.isEmpty():
            listed_ones = _with(listed_ones, fresh)
            places = _with(places, keep(_places(texts, fresh).groupBy("pattern", "value").agg(F.count("*").alias("times"), F.max("width").alias("width")), "graph"))
        graph = places.join(_side(patterns), "pattern", "left_semi")
        known = graph.join(believed, "value", "left")
        score = known.groupBy("pattern").agg((F.sum(F.col("times") * F.coalesce("belief", F.lit(0.0))) / (F.sum("times") + 1)).alias("confidence")).where(F.col("confidence") >= confidence)
        kinds = known.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.sum("belief").alias("n")).groupBy("pattern").agg(F.max_by("kind", F.struct("n", "kind")).alias("as_kind"))
        score = keep(score.join(kinds, "pattern"), "reliable")
        held = keep(graph.join(score, "pattern").join(seeds.select("value"), "value", "left_anti"), "held")
        if held.isEmpty():
            return None
        sides = held.groupBy("value", F.substring("pattern", 1, 1).alias("side")).agg(F.sum("times").alias("n"), F.max(F.struct("confidence", "pattern", "as_kind")).alias("best"))
        inside = keep(sides.groupBy("value").agg(F.max("n").alias("n"), F.max("best").alias("best")), "inside")
        plain = ~(F.col("value").rlike("[0-9]") & (F.char_length("value") >= 6))
        fresh = _without(inside.where(plain), totals, "value")
        if not fresh.isEmpty():
            totals = _with(totals, keep(_where(texts, fresh).groupBy("value").agg(F.count("*").alias("total")), "totals"))
        counted = inside.withColumn("total", F.lit(None).cast("long")) if totals is None else inside.join(totals, "value", "left")
        sure = F.col("best.confidence") * F.when(plain, F.least(F.lit(1.0), F.col("n") / F.col("total"))).otherwise(1.0)
        more = counted.select("value", F.col("best.as_kind").alias("kind"), (F.floor(sure * 1000) / 1000).alias("belief"))
        more = more.where(F.col("belief") >= F.floor(F.lit(confidence * 1000)) / 1000)
        if mark is not None:
            more = more.unionByName(believed.join(seeds.select("value"), "value", "left_anti").select("value", "kind", "belief"))
        more = keep(more.groupBy("value").agg(F.max_by("kind", F.struct("belief", "kind")).alias("kind"), F.max("belief").alias("belief")), "believed")
        now = tuple(more.agg(F.count("*"), F.coalesce(F.sum(F.round(F.col("belief") * 1000).cast("long")), F.lit(0))).first())
        if not now[0]:
            return None
        if now == mark:
            return held.join(more, "value").select("pattern", "value", "kind")
        if mark is None:  # texts without a base span may hold a seed too, such as the number of a card beside other numbers
            found = _with(found, keep(_where(texts.where("NOT seeded").where(F.col("glued").rlike(SEEDS)), seeds, marks).drop("i"), "found"))
        fresh = _without(more, located, "value")
        if not fresh.isEmpty():
            located = _with(located, fresh)
            found = _with(found, keep(_where(texts, fresh).drop("i"), "found"))
        mark = now
        believed = more.unionByName(seeds.select("value", "kind", F.lit(1.0).alias("belief")))


def _spans(marked: DataFrame, at: DataFrame) -> DataFrame:
    """(doc_id, mark, _added): ``at`` (doc_id, mark, i, width, kind) as spans of the rows of ``marked``, without those that meet a base span."""
    lists = keep(at.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("i", "width", "kind")).alias("at")).withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}), "at")
    some = _marked(marked, lists.select(F.col("_mark").alias("mark")))
    rows = some.join(_side(lists), F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("mark").eqNullSafe(F.col("_mark"))).dropDuplicates(["doc_id", "mark"])
    rows = rows.withColumns({"w": F.regexp_extract_all("glued", F.lit(WORD), F.lit(0)), "gap": F.transform(F.split("glued", WORD, -1), F.char_length)})
    rows = rows.select("doc_id", "mark", "base", "w", "gap", F.explode("at").alias("m")).select("doc_id", "mark", "base", "w", "gap", "m.*")
    add = lambda items: F.aggregate(items, F.lit(0), lambda a, n: a + n)
    size = lambda n: add(F.transform(F.slice("w", F.lit(1), n), F.char_length))
    begin = lambda n: add(F.slice("gap", F.lit(1), n + 1)) + size(n)
    last = F.col("i") + F.col("width") - 1
    opened = lambda n: F.char_length(F.get("w", n)) - F.char_length(F.ltrim(F.get("w", n), F.lit(OPENING)))
    start = begin(F.col("i")) + opened(F.col("i"))
    end = begin(last) + opened(last) + F.char_length(_core(F.get("w", last)))
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int") - 1
    rows = rows.withColumns({"start": start, "end": end, "rank": rank}).where(~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"])))
    rows = rows.withColumn("value", F.array_join(F.transform(F.slice("w", F.col("i") + 1, F.col("width")), _core), " "))
    found = rows.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "rank", "end", "kind", "value")).alias("all"))
    # of those inside one another the longest
    inner = lambda x: F.exists("all", lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (x["end"] - x["start"] < y["end"] - y["start"]))
    return found.select("doc_id", "mark", F.filter("all", lambda x: ~inner(x)).alias("_added"))


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of struct<start, rank, end, kind, value>; spans hold the learned ones too."""
    marked = base_spans(docs.drop("base", "spans"))
    own = marked.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("mark"), "base", _glued(F.col("text")).alias("glued"))
    own = keep(own.withColumn("seeded", F.size("base") > 0), "texts")
    seeds = own.select(F.explode("base").alias("b")).select(F.translate("b.value", BLANKS, GLUE * len(BLANKS)).alias("value"), "b.kind").groupBy("value").agg(F.min("kind").alias("kind"))
    more = learned(own, seeds)
    if more is None:
        return marked.withColumn("spans", F.col("base"))
    more = keep(more, "learned")
    at = _places(own, more.select("pattern").distinct()).join(_side(more), ["pattern", "value"]).groupBy("doc_id", "mark", "i", "width").agg(F.min("kind").alias("kind"))
    added = keep(_spans(own, at).withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}), "added")
    side = F.broadcast(added) if small(added, 100_000) else added
    whole = marked.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    return whole.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("_added", none)))).drop("_id", "_mark", "_added")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets, and n_chars brought up to date.

    Where spans overlap, the earlier one is replaced whole and the later one from where the earlier ends. Columns of ``docs``
    that are named like those of ``find_pii`` stay as they are.
    """
    docs, back = aside(docs, "base", "spans")
    found = find_pii(docs)
    text = F.col("text")
    done = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["end"] <= acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"])), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))),
    )
    out = found.withColumn("text", F.when(F.size("spans") > 0, done).otherwise(text)).drop("base", "spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(text.isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*docs.columns).withColumnsRenamed(back)
