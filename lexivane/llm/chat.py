"""Chat formatting in budgeted windows with a loss mask, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that mark structure in this or other common templates; inside texts a backslash breaks them up.
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]")
#: Tokens are estimated as a quarter of the characters, rounded up.
CHARS_A_TOKEN = 4
BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_TOKENS = 256


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one after the first character of every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    for c in CONTROL:
        text = F.replace(text, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_windows(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, target_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, window, n_repeated, n_turns, text, loss): each conversation in windows of `budget` tokens.

    Prefix sums of the turns' tokens lay a grid of what is left of the budget after the system turn and the
    history over the conversation. Turns that end in the cell they start in share a window; a turn that crosses
    into another cell has a window of its own, so only a turn that is longer than the budget exceeds it. A
    window opens with the conversation's first turn if its role is `system`, then repeats up to `history_turns`
    preceding turns of `history_tokens` together, then holds its own turns. `loss` has the (start, length) in
    code points of the escaped texts of its own `target_role` turns; repeated turns are masked.

    Rows are ordered by turn, role and text, nulls first, so ties and repeated rows have a defined order. Null
    roles and texts count as empty; rows with a null id make one conversation; an empty table gives an empty
    result; other columns are left out.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    d = df.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select(*d.columns, F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    d = d.withColumn("seg", F.concat("head", "body", F.lit(f"{END}\n"))).withColumn("size", F.ceil(F.length("seg") / CHARS_A_TOKEN).cast("long"))
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.select(
        "conv_id", "role", "head", "body", "seg", "size", F.row_number().over(w).alias("pos"), F.sum("size").over(rows).alias("upto"),
        F.first(F.when(F.col("role") == "system", F.col("seg"))).over(rows).alias("system"), F.first("size").over(rows).alias("size1"),
        *(F.lag(F.struct("seg", "size", "role"), k).over(w).alias(f"back{k}") for k in range(1, history_turns + 1)),
    )
    room = F.greatest(F.lit(1).cast("long"), F.lit(budget - history_tokens) - F.when(F.col("system").isNotNull(), F.col("size1")).otherwise(F.lit(0)))
    first, last = F.floor((F.col("upto") - F.col("size")) / room), F.floor((F.col("upto") - 1) / room)
    d = d.withColumn("window", F.when(first == last, 2 * first).otherwise(2 * last - 1).cast("long"))
    # How far back the history of a window goes: turns before its first one, without the system turn.
    taken, kept, turns = F.lit(0).cast("long"), F.lit(""), F.lit(0)
    open_ = F.lit(True)
    for k in range(1, history_turns + 1):
        back = F.col(f"back{k}")
        taken = taken + F.coalesce(back["size"], F.lit(0))
        open_ = open_ & back.isNotNull() & (taken <= history_tokens) & ~(F.col("system").isNotNull() & (F.col("pos") - k == 1))
        kept, turns = F.concat(F.when(open_, back["seg"]).otherwise(F.lit("")), kept), turns + open_.cast("int")
    led = F.col("system").isNotNull() & (F.col("pos") > 1)
    d = d.withColumn("history", F.concat(F.when(led, F.col("system")).otherwise(F.lit("")), kept)).withColumn("repeated", turns + led.cast("int"))
    turn = F.struct("pos", "seg", F.length("head").alias("head"), F.length("body").alias("body"), (F.col("role") == target_role).alias("target"), "history", "repeated")
    d = d.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    d = d.withColumn("history", F.col("t")[0]["history"]).withColumn("n_repeated", F.col("t")[0]["repeated"])
    starts = F.expr("aggregate(t, struct(cast(length(history) as long) as at, array() as spans), (a, x) -> struct(a.at + length(x.seg) as at, if(x.target, array_append(a.spans, struct(a.at + x.head as start, cast(x.body as long) as length)), a.spans) as spans), a -> a.spans)".replace("array() as spans", "cast(array() as array<struct<start:bigint,length:bigint>>) as spans"))
    text = F.concat("history", F.array_join(F.transform("t", lambda x: x["seg"]), ""))
    return d.select("conv_id", "window", "n_repeated", F.size("t").alias("n_turns"), text.alias("text"), starts.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from formatted windows alone: n_turns, turns (role, newline, text, newline each), loss text and formatted_chars."""
    d = windows.withColumn("segs", F.expr(f"slice(split(text, '{START.replace('|', '[|]')}'), 2 + n_repeated, greatest(0, size(split(text, '{START.replace('|', '[|]')}')) - 1 - n_repeated))"))

    def turn(seg: Column) -> Column:
        role = F.substring_index(seg, "\n", 1)
        body = F.substr(seg, F.length(role) + 2, F.length(seg) - F.length(role) - F.lit(len(END) + 2))
        return F.concat(_role_in(role), F.lit("\n"), unescape(body), F.lit("\n"))

    turns = F.array_join(F.transform("segs", turn), "")
    loss = F.array_join(F.transform("loss", lambda x: unescape(F.substr(F.col("text"), (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")
    d = d.select("conv_id", "window", F.size("segs").alias("n"), turns.alias("turns"), loss.alias("loss"), F.length("text").alias("chars"))
    d = d.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("t"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    turns, loss = (F.array_join(F.col("t")[c], "").alias(c) for c in ("turns", "loss"))
    return d.select("conv_id", F.col("n_turns").cast("long"), turns, loss, F.col("formatted_chars").cast("long"))


def _sql_escape(text: str) -> str:
    text = f"replace({text}, '\\', '\\\\')"
    for c in CONTROL:
        text = f"replace({text}, '{c}', '{c[0]}\\{c[1:]}')"
    return text


#: SQL over `conversations` with the same result as the query.
SQL = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s as (select *, {len(START) + len(END) + 2} + length({_sql_escape("replace(replace(role, '%', '%25'), chr(10), '%0A')")}) + length({_sql_escape('text')}) as len from c),
t as (select *, ((len + {CHARS_A_TOKEN - 1}) // {CHARS_A_TOKEN})::bigint as size from s),
p as (select *, row_number() over w as pos, sum(size) over (w rows unbounded preceding) as upto, first_value(role) over w = 'system' as led, first_value(size) over w as size1, first_value(len) over w as len1,
 lag(size, 1) over w as s1, lag(len, 1) over w as l1, lag(size, 2) over w as s2, lag(len, 2) over w as l2
 from t window w as (partition by conv_id order by turn nulls first, role, text)),
r as (select *, greatest(1, {BUDGET - HISTORY_TOKENS} - case when led then size1 else 0 end)::bigint as room from p),
v as (select *, ((upto - size) // room)::bigint as a, ((upto - 1) // room)::bigint as b from r),
x as (select *, case when a = b then 2 * a else 2 * b - 1 end as win,
 coalesce(s1 <= {HISTORY_TOKENS} and not (led and pos = 2), false) as h1 from v),
y as (select *, coalesce(h1 and s1 + s2 <= {HISTORY_TOKENS} and not (led and pos = 3), false) as h2, row_number() over (partition by conv_id, win order by pos) = 1 as opens from x)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
 coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '')) as loss_sha256,
 sum(len + case when opens then case when h1 then l1 else 0 end + case when h2 then l2 else 0 end + case when led and pos > 1 then len1 else 0 end else 0 end)::bigint as formatted_chars
from y group by conv_id
"""
