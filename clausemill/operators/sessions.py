"""Roll-up of interaction events by session and by card.

Events are ordered by seq (missing last), then by the line of the log. A heartbeat reports cumulative times of
the open entry of a screen, and of the screens beneath it; a value below the last one opens a new entry. A
screen view of some length closes the entry. Time before the session's start does not count: what an entry
reports beyond the elapsed time at its first event is taken off. All of this is windows and aggregates; the
boundary rule needs only the row before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.functions.numeric import seconds_text

#: The closed vocabularies of the event log.
SCREENS = ("profile", "analyzing", "results", "preview", "ask_ai")
SERVER_EVENTS = ("session_start", "session_end")
CARD_EVENTS = ("change_card_expand", "change_card_collapse", "original_clause_open")
MIN_VIEW_MS = 100
SEEN_MS = 1000

_UNDER = "array<struct<screen:string,screen_ms:string,active_ms:string,cards:string>>"
_CARD = "struct<card_id:string,title:string,risk_grade:string,category:string,position:string,change_type:string>"
KEYS = ["participant_id", "session_id"]


def data(path: str) -> Column:
    return F.get_json_object("data", f"$.{path}")


def number(c: Column) -> Column:
    """A JSON number as double, 0 for anything else."""
    return F.coalesce(F.when(c.rlike(r"^-?[0-9]"), c.try_cast("double")), F.lit(0.0))


def ordered(events: DataFrame) -> DataFrame:
    """Adds ``ord``, a struct that sorts the events of a session: seq ascending, missing last, then line."""
    return events.withColumn("ord", F.struct(F.isnull("seq").alias("none"), F.col("seq").alias("seq"), F.col("line").alias("line")))


def screen_reports(events: DataFrame) -> DataFrame:
    """One row for each report of a screen: kind (hb, view), screen, wall and active ms, cards, t_ms and order."""
    ev = F.col("event_type")
    top = T.screen_key(F.coalesce(F.nullif(data("screen"), F.lit("")), F.col("screen"), F.lit("")))
    seen = T.screen_key(F.coalesce(F.nullif(F.col("screen"), F.lit("")), data("screen"), F.lit("")))
    row = lambda kind, sub, screen, wall, active, cards: F.struct(F.lit(kind).alias("kind"), sub.cast("int").alias("sub"), screen.alias("at"), wall.alias("wall"), active.alias("active"), cards.alias("cards"))
    own = row("hb", F.lit(0), top, number(data("screen_ms")), number(data("active_ms")), data("cards"))
    under = F.coalesce(F.from_json(data("under"), _UNDER), F.expr("array()").cast(_UNDER))
    below = F.transform(under, lambda u, i: row("hb", i + 1, T.screen_key(F.coalesce(u["screen"], F.lit(""))), number(u["screen_ms"]), number(u["active_ms"]), u["cards"]))
    view = row("view", F.lit(0), seen, number(data("duration_ms")), number(data("active_ms")), data("cards"))
    reports = F.when(ev == "heartbeat", F.concat(F.array(own), below)).when((ev == "screen_view") & (number(data("duration_ms")) >= MIN_VIEW_MS), F.array(view))
    return events.select(*KEYS, "t_ms", "ord", F.explode(reports).alias("r")).select(*KEYS, "t_ms", "ord", "r.*").where("at != ''")


def entries(reports: DataFrame) -> DataFrame:
    """Adds ``entry``, the number of the screen's entry, and ``before``, its time before the session."""
    by = Window.partitionBy(*KEYS, "at").orderBy("ord", "sub")
    kind, wall = F.lag("kind").over(by), F.lag("wall").over(by)
    opens = F.isnull(kind) | (kind == "view") | ((F.col("kind") == "hb") & (F.col("wall") < wall))
    numbered = reports.withColumn("opens", opens).withColumn("entry", F.sum(F.col("opens").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered


def screen_times(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session, screen, wall, active) and (session, card, visible, expanded), summed over entries."""
    numbered = entries(reports)
    own = [*KEYS, "at", "entry"]
    pre = F.when(F.col("opens") & F.col("t_ms").isNotNull(), F.greatest(F.lit(0.0), F.col("wall") - F.col("t_ms"))).when(F.col("opens"), F.lit(0.0))
    spans = numbered.groupBy(*own).agg(F.max("wall").alias("wall"), F.max("active").alias("active"), F.max(pre).alias("pre"))
    inside = spans.withColumn("inside", F.greatest(F.lit(0.0), F.col("wall") - F.col("pre")))
    screens = inside.groupBy(*KEYS, "at").agg(F.sum("inside").alias("wall"), F.sum(F.least("active", "inside")).alias("active"))
    each = F.explode(F.from_json("cards", "map<string,struct<visible_ms:string,expanded_ms:string>>")).alias("card_id", "c")
    cards = numbered.where("at = 'results' AND cards IS NOT NULL").select(*own, each)
    most = cards.groupBy(*own, "card_id").agg(F.max(number(F.col("c.visible_ms"))).alias("v"), F.max(number(F.col("c.expanded_ms"))).alias("e"))
    told = most.join(inside.select(*own, "inside"), own)
    return screens, told.groupBy(*KEYS, "card_id").agg(F.sum(F.least("v", "inside")).alias("visible_ms"), F.sum(F.least("e", "inside")).alias("expanded_ms"))


def _first(value: Column, when: Column) -> Column:
    return F.min_by(value, F.when(when, F.col("ord")))


def _last(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("ord")))


def card_rollup(events: DataFrame, card_times: DataFrame) -> DataFrame:
    """One row a session and card: its description, expansions, times, whether its original was opened."""
    ev = F.col("event_type")
    shown = events.where(ev == "analysis_result").select(*KEYS, "ord", F.posexplode(F.from_json(data("cards"), f"array<{_CARD}>")).alias("i", "c"))
    shown = shown.where("c.card_id IS NOT NULL").select(*KEYS, F.struct(F.lit(0).alias("rank"), "ord", "i").alias("place"), "c.*")
    told = events.where(ev.isin(*CARD_EVENTS) & data("card_id").isNotNull())
    own = told.select(*KEYS, F.struct(F.lit(1).alias("rank"), "ord", F.lit(0).alias("i")).alias("place"), *[data(k).alias(k) for k in ("card_id", "title", "risk_grade", "category", "position")], F.lit(None).cast("string").alias("change_type"))
    timed = card_times.select(*KEYS, "card_id")
    fields = ("title", "risk_grade", "category", "position", "change_type")
    info = shown.unionByName(own).groupBy(*KEYS, "card_id").agg(F.min_by(F.struct(*fields), "place").alias("f"), F.min("place").alias("place"))
    clicks = told.groupBy(*KEYS, data("card_id").alias("card_id")).agg(
        F.count_if(ev == "change_card_expand").alias("n_expands"),
        F.bool_or(ev == "original_clause_open").alias("opened_original"),
        _first(F.col("t_ms"), (ev == "change_card_expand") & F.col("t_ms").isNotNull()).alias("first_expand_t_ms"),
    )
    keys = [*KEYS, "card_id"]
    all_ = info.select(*keys).union(timed).distinct()
    out = all_.join(info, keys, "left").join(clicks, keys, "left").join(card_times, keys, "left")
    whole = lambda c: F.floor(F.coalesce(c, F.lit(0.0))).cast("long")
    return out.select(
        *keys,
        *[F.coalesce(F.col(f"f.{k}"), F.lit("")).alias(k) for k in fields],
        F.coalesce("n_expands", F.lit(0)).alias("n_expands"),
        whole(F.col("expanded_ms")).alias("expanded_ms"),
        whole(F.col("visible_ms")).alias("visible_ms"),
        F.coalesce("opened_original", F.lit(False)).alias("opened_original"),
        "first_expand_t_ms",
        "place",
    )


def session_rollup(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session rows and card rows of an event log (EVENT with ``line``)."""
    events = ordered(events)
    screens, card_times = screen_times(screen_reports(events))
    cards = card_rollup(events, card_times)
    ev, t = F.col("event_type"), F.col("t_ms")
    picked = lambda name: _last(F.col("data"), (ev == "profile_selection") & (data("field") == name))
    start, end, hello, result = ev == "session_start", ev == "session_end", ev == "client_hello", ev == "analysis_result"
    base = events.groupBy(*KEYS).agg(
        F.coalesce(_first(F.col("server_ts"), start), _first(F.col("server_ts"), F.coalesce(F.col("server_ts"), F.lit("")) != ""), F.lit("")).alias("started_at"),
        F.bool_or(end).alias("ended"),
        _first(data("end_reason"), end).alias("end_reason"),
        _first(data("duration_ms"), end).alias("end_ms"),
        _first(data("note"), end).alias("note"),
        F.coalesce(F.max("t_ms"), F.lit(0)).alias("max_t"),
        _first(F.col("app_commit"), F.coalesce(F.col("app_commit"), F.lit("")) != "").alias("app_commit"),
        _first(data("model_dir"), start).alias("model_dir"),
        *[_first(data(k), hello).alias(k) for k in ("ollama_model", "risk_scorer", "diff_inject_classifier_context")],
        F.count_if(~ev.isin(*SERVER_EVENTS)).alias("n_client_events"),
        F.count_if(ev == "heartbeat").alias("n_heartbeats"),
        _first(t, (T.screen_key(F.coalesce("screen", F.lit(""))) == "results") & t.isNotNull()).alias("results_ms"),
        *[picked(k).alias(f"p_{k}") for k in ("service", "role", "concerns", "mode", "context")],
        _first(data("cards"), result).alias("shown"),
        F.bool_or(result).alias("has_result"),
        F.count_if(ev == "category_toggle").alias("n_category_toggles"),
        F.count_if(ev == "preview_toggle").alias("n_preview_toggles"),
        F.count_if(ev == "ask_ai_open").alias("n_ask_ai_opens"),
        F.count_if(ev == "ask_ai_message").alias("n_ask_ai_messages"),
        F.floor(F.sum(F.when(ev == "ask_ai_message", number(data("length"))).otherwise(0.0))).cast("long").alias("ask_ai_chars"),
        F.count_if(ev == "click").alias("n_clicks"),
    )
    walls = screens.groupBy(*KEYS).pivot("at", list(SCREENS)).agg(F.sum("wall").alias("wall"), F.sum("active").alias("active"))
    per = cards.groupBy(*KEYS).agg(
        F.count_if(F.col("n_expands") > 0).alias("n_cards_expanded_unique"),
        F.sum("n_expands").alias("n_expands"),
        F.count_if("opened_original").alias("n_original_clause_open_unique"),
        F.count_if(F.col("visible_ms") >= SEEN_MS).alias("n_cards_seen_1s"),
    )
    told = base.join(walls, KEYS, "left").join(per, KEYS, "left")
    shown = F.from_json("shown", f"array<{_CARD}>")
    value = lambda k: F.coalesce(F.get_json_object(f"p_{k}", "$.value"), F.lit(""))
    concerns = F.from_json(F.get_json_object("p_concerns", "$.value"), "array<string>")
    listed = F.get_json_object("p_concerns", "$.value").startswith("[")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    seconds = lambda c: seconds_text(F.coalesce(F.col(c), F.lit(0.0)))
    sessions = told.select(
        *KEYS, "started_at", "ended", blank("end_reason").alias("end_reason"),
        F.coalesce(F.col("end_ms").try_cast("long"), F.col("max_t")).alias("duration_ms"),
        *[blank(c).alias(c) for c in ("note", "app_commit", "model_dir", "ollama_model", "risk_scorer", "diff_inject_classifier_context")],
        "n_client_events", "n_heartbeats",
        *[seconds(f"{s}_{k}").alias(f"{s}_{k}_s") for s in SCREENS for k in ("wall", "active")],
        F.when(F.col("results_ms").isNull(), "").otherwise(seconds_text(F.col("results_ms"))).alias("time_to_results_s"),
        value("service").alias("profile_service"), value("role").alias("profile_role"),
        F.when(listed, F.array_join(concerns, ";")).otherwise(value("concerns")).alias("profile_concerns"),
        value("mode").alias("profile_mode"), F.coalesce(F.get_json_object("p_context", "$.length"), F.lit("")).alias("profile_context_length"),
        F.when(F.col("has_result"), F.coalesce(F.size(shown), F.lit(0))).alias("n_cards_shown"),
        F.when(F.col("has_result"), F.coalesce(F.size(F.filter(shown, lambda c: c["risk_grade"] == "harmful")), F.lit(0))).alias("n_harmful_shown"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_cards_expanded_unique", "n_expands", "n_original_clause_open_unique", "n_cards_seen_1s")],
        "n_category_toggles", "n_preview_toggles", "n_ask_ai_opens", "n_ask_ai_messages", "ask_ai_chars", "n_clicks",
    )
    return sessions, cards


def participant_order() -> list[Column]:
    """Numeric participants first, by number; then the others by text; then by start and session."""
    p = F.col("participant_id")
    digits = p.rlike("^[0-9]+$")
    return [~digits, F.when(digits, p).try_cast("decimal(38,0)"), p, F.col("started_at"), F.col("session_id")]


def cumulative_entries(rows: DataFrame, key: str, order: str, counter: str) -> DataFrame:
    """Totals of a cumulative counter that starts again: the maximum of every entry, summed; and how many entries."""
    by = Window.partitionBy(key).orderBy(order)
    opens = F.coalesce(F.col(counter) < F.lag(counter).over(by), F.lit(True)).cast("int")
    numbered = rows.withColumn("__opens", opens).withColumn("__entry", F.sum("__opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    most = numbered.groupBy(key, "__entry").agg(F.max(counter).alias("most"))
    return most.groupBy(key).agg(F.sum("most").alias("total"), F.count("*").alias("entries"))
