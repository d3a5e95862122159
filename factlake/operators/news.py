"""News payloads of eight providers read into one schema, as VARIANT columns with one projection each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import Registry
from ..sources.bridge import read

registry = Registry()

#: Where each provider's payload has its articles and their fields; of several paths the first with text counts.
PROVIDERS: dict[str, dict] = {
    "marketaux": {"items": "$.data", "description": ["$.description", "$.snippet"], "content": ["$.snippet"], "published": "$.published_at", "symbols": ("$.entities", "$.symbol"), "sentiment": ("$.entities", "$.sentiment_score")},
    "finnhub": {"items": "$", "title": "$.headline", "description": ["$.summary"], "content": ["$.summary"], "epoch": "$.datetime", "symbol": "$.related"},
    "alphavantage": {"items": "$.feed", "description": ["$.summary"], "content": ["$.summary"], "compact": "$.time_published", "symbols": ("$.ticker_sentiment", "$.ticker"), "score": "$.overall_sentiment_score", "author": ["$.authors"]},
    "newsdata": {"items": "$.results", "status": "success", "content": ["$.content", "$.description"], "url": "$.link", "source": ["$.source_id", "$.source_name"], "published": "$.pubDate", "author": ["$.creator"]},
    "newsapi_ai": {"items": "$.articles.results", "description": ["$.body"], "content": ["$.body"], "source": ["$.source.title", "$.source"], "published": ["$.dateTime", "$.date"], "author": ["$.authors"], "language": "$.lang"},
    "worldnews": {"items": "$.news", "description": ["$.summary"], "content": ["$.text"], "source": ["$.source_country"], "published": "$.publish_date", "author": ["$.authors", "$.author"]},
    "gnews": {"items": "$.articles", "content": ["$.content", "$.description"], "source": ["$.source.name", "$.source"], "published": "$.publishedAt"},
    "newsapi_org": {"items": "$.articles", "not_status": "error", "content": ["$.content", "$.description"], "source": ["$.source.name", "$.source"], "published": "$.publishedAt", "author": ["$.author"]},
}
#: Characters of a body that stand for its description, where a provider has none.
SHORT = 280


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _text(v: Column, paths) -> Column:
    """The first text at the paths that is a string and not empty."""
    found = [F.when(F.schema_of_variant(_get(v, p)) == "STRING", F.nullif(F.try_variant_get(v, p, "string"), F.lit(""))) for p in ([paths] if isinstance(paths, str) else paths)]
    return F.coalesce(*found, F.lit(None).cast("string"))


def _number(v: Column, path: str, strings: bool = False) -> Column:
    kind = F.schema_of_variant(_get(v, path))
    allowed = kind.rlike("^(BIGINT|DOUBLE|DECIMAL)") | (F.lit(strings) & (kind == "STRING"))
    return F.when(allowed, F.try_variant_get(v, path, "string").try_cast("double"))


def _array(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(_get(v, path)).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def _authors(v: Column, path: str) -> Column:
    """A byline: a string, or the strings and names in a list."""
    listed = F.array_compact(F.transform(_array(v, path), lambda a: F.coalesce(_text(a, "$"), _text(a, "$.name"))))
    return F.coalesce(_text(v, path), F.when(F.size(listed) > 0, F.array_join(listed, ", ")))


def _articles(rows: DataFrame, provider: str) -> DataFrame:
    """One provider's payloads (payload_id, v) as articles with their state."""
    of = PROVIDERS[provider]
    root = F.schema_of_variant("v")
    listed = _array(F.col("v"), of["items"])
    shape = F.col("v").isNotNull() & root.startswith("ARRAY" if of["items"] == "$" else "OBJECT")
    status = _text(F.col("v"), "$.status")
    refused = F.coalesce(status != of["status"], F.lit(False)) if "status" in of else F.coalesce(status == of["not_status"], F.lit(False)) if "not_status" in of else F.lit(False)
    state = F.when(~F.coalesce(shape, F.lit(False)), "broken").when(refused, "refused").when(F.coalesce(F.size(listed), F.lit(0)) <= 0, "empty").otherwise("article")
    item = rows.withColumn("state", state).withColumn("items", F.when(F.col("state") == "article", F.filter(listed, lambda x: F.schema_of_variant(x).startswith("OBJECT"))))
    item = item.select("payload_id", "state", F.posexplode_outer("items").alias("place", "x"))
    x = F.col("x")
    text = lambda field, default: _text(x, of.get(field, default))
    day = F.lit(None).cast("date")
    if "published" in of:
        day = F.coalesce(*(F.try_to_date(F.substring(_text(x, p), 1, 10), "yyyy-MM-dd") for p in ([of["published"]] if isinstance(of["published"], str) else of["published"])))
    if "epoch" in of:
        seconds = _number(x, of["epoch"])
        day = F.when((seconds > 0) & (seconds < 253402300800), F.to_date(F.timestamp_seconds(seconds.cast("long"))))
    if "compact" in of:
        day = F.try_to_date(F.substring(_text(x, of["compact"]), 1, 8), "yyyyMMdd")
    none = F.array().cast("array<string>")
    symbols, sentiment = none, F.lit(None).cast("double")
    if "symbols" in of:
        path, key = of["symbols"]
        symbols = F.coalesce(F.array_compact(F.transform(_array(x, path), lambda e: _text(e, key))), none)
    if "symbol" in of:
        symbols = F.array_compact(F.array(_text(x, of["symbol"])))
    if "sentiment" in of:
        path, key = of["sentiment"]
        sentiment = F.get(F.array_compact(F.transform(_array(x, path), lambda e: _number(e, key))), F.lit(0))
    if "score" in of:
        sentiment = _number(x, of["score"], strings=True)
    description = text("description", "$.description")
    if provider == "newsapi_ai":
        description = F.substring(description, 1, SHORT)
    author = F.coalesce(*(_authors(x, p) for p in of["author"])) if "author" in of else F.lit(None).cast("string")
    language = _text(x, of["language"]) if "language" in of else F.when(x.isNotNull(), "en")
    return item.select(
        "payload_id", F.lit(provider).alias("provider"), F.when(F.col("place").isNull() & (F.col("state") == "article"), "empty").otherwise(F.col("state")).alias("state"), "place", F.when(x.isNotNull(), F.coalesce(text("title", "$.title"), F.lit(""))).alias("title"), description.alias("description"), text("content", "$.content").alias("content"),
        text("url", "$.url").alias("url"), text("source", ["$.source"]).alias("source"), author.alias("author"), day.alias("published_on"), language.alias("language"), F.when(x.isNotNull(), symbols).alias("symbols"), sentiment.alias("sentiment"),
    )


def news_articles(payloads: DataFrame) -> DataFrame:
    """(payload_id, provider, state, place, title, description, content, url, source, author, published_on, language, symbols, sentiment).

    payloads: (payload_id, provider, payload), payload a JSON text. Each payload is parsed once. An
    article is a row with its place in the payload. A payload that is no JSON or of another shape is
    one row with state broken, one that the provider marks as failed is refused, one without
    articles empty, of a provider not listed unknown. Fields that are no text where text is due are
    null, a missing title is empty; dates come from epoch seconds (UTC), YYYYMMDDT..., or ISO texts.
    """
    parsed = payloads.select("payload_id", "provider", F.try_parse_json("payload").alias("v"))
    known = [_articles(parsed.where(F.col("provider") == p).select("payload_id", "v"), p) for p in PROVIDERS]
    out = reduce(DataFrame.unionByName, known)
    other = payloads.where(~F.coalesce(F.col("provider").isin(*PROVIDERS), F.lit(False))).select("payload_id", "provider", F.lit("unknown").alias("state"))
    return out.unionByName(other, allowMissingColumns=True)


_ORDER = list(PROVIDERS)


@registry.add(
    "news_articles",
    f"""WITH e AS (SELECT event_id, event_id % 9 AS k, event_type, value, CAST(CAST(ts AS TIMESTAMP) AS DATE) AS d FROM events)
    SELECT event_id AS payload_id, CASE k {' '.join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_ORDER))} ELSE 'gnews' END AS provider, CASE WHEN k = 8 THEN 'broken' ELSE 'article' END AS state, CASE WHEN k < 8 THEN 'About ' || event_type END AS title,
      CASE WHEN k < 8 THEN 'text ' || event_id END AS content, CASE WHEN k < 8 THEN 'http://n.example/' || event_id END AS url, CASE WHEN k < 8 THEN d END AS published_on, CASE WHEN k IN (0, 2) THEN value END AS sentiment, CASE WHEN k IN (0, 1, 2) THEN 'S' || event_id % 5 END AS symbol FROM e""",
)
def news_articles_query(spark, sf_dir):
    """Events printed as payloads of each provider in turn, and as broken ones."""
    e = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 9).alias("k"), "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    title, body, url = F.concat(F.lit("About "), "event_type"), F.concat(F.lit("text "), F.col("event_id").cast("string")), F.concat(F.lit("http://n.example/"), F.col("event_id").cast("string"))
    iso, symbol = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(F.lit("S"), (F.col("event_id") % 5).cast("string"))
    s = lambda **fields: F.struct(*(v.alias(k) for k, v in fields.items()))
    doc = lambda key, article, **more: F.to_json(s(**more, **{key: F.array(article)}))
    shapes = [
        doc("data", s(title=title, snippet=body, url=url, published_at=iso, entities=F.array(s(symbol=symbol, sentiment_score=F.col("value"))))),
        F.to_json(F.array(s(headline=title, summary=body, url=url, datetime=F.unix_timestamp("ts"), related=symbol))),
        doc("feed", s(title=title, summary=body, url=url, time_published=F.date_format("ts", "yyyyMMdd'T'HHmmss"), overall_sentiment_score=F.col("value"), ticker_sentiment=F.array(s(ticker=symbol)))),
        doc("results", s(title=title, content=body, link=url, pubDate=F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), status=F.lit("success")),
        F.to_json(s(articles=s(results=F.array(s(title=title, body=body, url=url, dateTime=iso))))),
        doc("news", s(title=title, text=body, url=url, publish_date=F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))),
        doc("articles", s(title=title, content=body, url=url, publishedAt=iso)),
        doc("articles", s(title=title, content=body, url=url, publishedAt=iso), status=F.lit("ok")),
    ]
    payload = reduce(lambda made, i: F.when(F.col("k") == i, shapes[i]).otherwise(made), range(8), F.lit("{not json"))
    provider = F.element_at(F.array(*map(F.lit, [*_ORDER, "gnews"])), (F.col("k") + 1).cast("int"))
    found = news_articles(e.select(F.col("event_id").alias("payload_id"), provider.alias("provider"), payload.alias("payload")))
    return found.select("payload_id", "provider", "state", "title", "content", "url", "published_on", "sentiment", F.get("symbols", F.lit(0)).alias("symbol"))
