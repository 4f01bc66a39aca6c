"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. DataFrame functions only.

Kinds, in this order: email, ip (four parts of at most 255), card (13 to 19 digits that pass Luhn), phone (9 to 15 digits),
and iban (mod-97). Matches are leftmost and do not overlap within a kind; a match that fails its check is dropped and not
tried again. Offsets count code points, ends are exclusive. They come from cutting a text at its matches: the lengths of
the parts before and between them add up to each start. Running sums and maxima are taken in runs of about the root of their
number, then over the runs' ends, and a redacted text is put together from blocks of BLOCK code points. The patterns are possessive and
begin only where a run begins or the last match ended. So no text takes time in the square of its length or spans, nor a deep stack.

score is the kind's own weight, raised by a word of its context within NEAR characters before or after the span, lowered by a word
that speaks against it. It ranks spans and drops none.

Defined results. A null text counts as empty and has no spans. Repeated rows give repeated rows, an empty table none; texts
are read whole; of other columns only those asked for are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR, BLOCK = 40, 512
#: kind, pattern, cheap test that a text may have one, check of a match s.text, weight, words for, words against
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", "true", 0.9, "mail|contact|write|e-mail|email", "example"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"rlike(t, '[0-9]\\.[0-9]')", "forall(split(s.text, '[.]'), x -> length(ltrim('0', x)) <= 3 and coalesce(try_cast(ltrim('0', x) as int), 0) <= 255)", 0.6, "ip|host|server|address|login|from", "version|release|section|v"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"rlike(t, '[0-9](?:[\\x20-]?[0-9]){12}')", "length(translate(s.text, ' -', '')) between 13 and 19 and luhn_check(translate(s.text, ' -', ''))", 0.8, "card|credit|debit|visa|pay|payment", "order|tracking|isbn"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')", "length(regexp_replace(s.text, '[^0-9]', '')) between 9 and 15", 0.7, "phone|call|tel|telephone|mobile|fax", "order|id"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "rlike(t, '[A-Z]{2}[0-9]{2}')", "aggregate(split(concat(substring(translate(s.text, ' ', ''), 5), substring(s.text, 1, 4)), ''), 0, (r, c) -> case when c = '' then r when c between '0' and '9' then (r * 10 + cast(c as int)) % 97 else (r * 100 + ascii(c) - 55) % 97 end) = 1", 0.8, "iban|bank|account", "order|serial"),
)
BASE = ("email", "ip", "card", "phone")


def literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scanned(values: str, join: str) -> str:
    """SQL of the running totals of an array of ints; `join` is SQL of two ints x and y, with 0 as its neutral element.

    Runs of about the root of the array's size, then the runs' last values: lists are copied n to the power 1.5 times, not n squared."""
    both = join.format
    width = f"cast(sqrt(size({values})) as int) + 1"
    runs = f"transform(sequence(0, (size({values}) - 1) div ({width})), k -> slice({values}, k * ({width}) + 1, {width}))"

    def run(list_: str) -> str:
        return f"aggregate({list_}, cast(array() as array<int>), (acc, v) -> concat(acc, array({both(x='coalesce(try_element_at(acc, -1), 0)', y='v')})))"

    local = f"transform({runs}, r -> {run('r')})"
    tops = run("transform(l, r -> element_at(r, -1))")
    whole = f"transform(array(named_struct('l', {local})), s -> transform(array(named_struct('l', s.l, 'tops', {tops.replace('transform(l,', 'transform(s.l,')})), z -> flatten(transform(z.l, (r, k) -> transform(r, v -> {both(x='coalesce(get(z.tops, k - 1), 0)', y='v')})))))"
    return f"case when size({values}) > 0 then flatten(flatten({whole})) else cast(array() as array<int>) end"


def _marked(df: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """row (a struct of the kept columns, whatever their names), t (the text, null as empty) and spans."""
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    out = out.withColumns({f"m_{k}": F.expr(f"case when {test} then regexp_extract_all(t, {literal(pattern)}, 0) else cast(array() as array<string>) end") for k, pattern, test, *_ in KINDS})
    out = out.withColumns({f"p_{k}": F.expr(f"case when size(m_{k}) > 0 then split(t, {literal(pattern)}, -1) else cast(array() as array<string>) end") for k, pattern, *_ in KINDS})
    out = out.withColumns({f"n_{k}": F.expr(f"zip_with(m_{k}, slice(p_{k}, 1, size(m_{k})), (m, p) -> length(p) + length(m))") for k, *_ in KINDS})
    out = out.withColumns({f"e_{k}": F.expr(scanned(f"n_{k}", "{x} + {y}")) for k, *_ in KINDS})
    for k, *_ in KINDS:
        spans = f"arrays_zip(m_{k}, slice(p_{k}, 1, size(m_{k})), slice(p_{k}, 2, size(m_{k})), e_{k})"
        made = f"transform({spans}, x -> named_struct('kind', '{k}', 'start', x.e_{k} - length(x.m_{k}), 'end', x.e_{k}, 'text', x.m_{k}, 'before', lower(right(x.`1`, {NEAR})), 'after', lower(left(x.`2`, {NEAR}))))"
        out = out.withColumn(f"s_{k}", F.expr(f"case when size(m_{k}) > 0 then {made} else cast(array() as array<struct<kind:string,start:int,end:int,text:string,before:string,after:string>>) end"))

    def near(words: str) -> str:
        pattern = literal(rf"(?<![a-z])(?:{words})(?![a-z])")
        return f"(rlike(s.before, {pattern}) or rlike(s.after, {pattern}))"

    checked = [f"transform(filter(s_{k}, s -> {check}), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'text', s.text, 'score', {weight}D + case when {near(pro)} then 0.1D else 0D end - case when {near(con)} then 0.3D else 0D end))" for k, _, _, check, weight, pro, con in KINDS]
    return out.select("row", "t", F.expr(f"concat({', '.join(checked)})").alias("spans"))


def with_spans(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and spans: array<struct<kind, start, end, text, score>>, by kind, then start."""
    return _marked(df, text_col, keep).select(*[F.col("row")[c].alias(c) for c in keep], "spans")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(df: DataFrame) -> DataFrame:
    """op7: counts and digests of the spans of every document; scores are in the order of spans."""
    s = F.col("spans")
    base = F.filter(s, lambda x: x["kind"].isin(*BASE))
    return with_spans(df).select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(s).alias("spans"),
        F.coalesce(F.array_max(F.transform(s, lambda x: x["score"])), F.lit(0.0)).alias("top_score"),
        F.array_join(F.transform(s, lambda x: F.format_number(x["score"], 1)), ",").alias("scores"),
    )


def redact(df: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """The table with each span of its text replaced by its kind in angle brackets and n_chars counted anew; overlapping spans become
    one, of the first one's kind. Texts without spans stay as they are, nulls included."""
    names = df.columns
    out = _marked(df, text_col, tuple(names)).withColumn("some", F.expr("size(spans) > 0"))
    # in order of start, of equal ones in order of kind; `reach` is how far the spans up to each one reach
    out = out.withColumn("o", F.expr("array_sort(transform(spans, (s, i) -> named_struct('start', s.start, 'i', i, 'end', s.end, 'kind', s.kind)))"))
    out = out.withColumn("ends", F.expr("transform(o, s -> s.end)"))
    out = out.withColumn("reach", F.expr(scanned("ends", "greatest({x}, {y})")))
    out = out.withColumn("blocks", F.expr(f"case when some then regexp_extract_all(t, '(?s).{{1,{BLOCK}}}', 0) end"))

    def between(a: str, b: str) -> str:
        """SQL of the text from place a to place b."""
        first, last = f"({a}) div {BLOCK}", f"({b}) div {BLOCK}"
        inside = f"substring(get(blocks, cast({first} as int)), ({a}) % {BLOCK} + 1, ({b}) - ({a}))"
        across = f"concat(substring(get(blocks, cast({first} as int)), ({a}) % {BLOCK} + 1), array_join(slice(blocks, cast({first} as int) + 2, cast({last} - {first} as int) - 1), ''), coalesce(substring(get(blocks, cast({last} as int)), 1, ({b}) % {BLOCK}), ''))"
        return f"case when ({a}) >= ({b}) then '' when {first} = {last} then {inside} else {across} end"

    # a span that begins before the reach of those before it is part of what they replace
    before = "coalesce(get(reach, i - 1), 0)"
    parts = f"transform(o, (s, i) -> case when s.start >= {before} then concat({between(before, 's.start')}, '<', upper(s.kind), '>') else '' end)"
    build = f"concat(array_join({parts}, ''), {between('element_at(reach, -1)', 'length(t)')})"
    clean = out.select("row", F.expr(f"case when some then {build} else row.`{text_col}` end").alias("clean"))
    return clean.select(*[F.col("clean").alias(c) if c == text_col else F.length("clean").cast("long").alias(c) if c == n_chars_col else F.col("row")[c].alias(c) for c in names])
