"""Knowledge graphs of stories: typed nodes and edges, with places found by name or by part of a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut


def _grams(c: Column, least: int, most: int) -> Column:
    """All different runs of ``least`` to ``most`` letters."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    runs = [F.when(F.length(c) >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in range(least, most + 1)]
    return F.array_distinct(F.concat(*runs))


def contained_in(small: DataFrame, large: DataFrame, block: str, q: int = 3) -> DataFrame:
    """(block, small, large): all pairs of a block where a text of ``small`` lies in one of ``large``, without a nested loop.

    The larger texts are listed by their runs of up to ``q`` letters. A text is looked up once, by the run of ``q`` letters
    (a shorter text: by itself) that fewest of them have, and what is found is verified. Empty and null texts lie nowhere.
    """
    listed = large.where("large <> ''").select(block, "large").distinct().select(block, "large", F.explode(_grams(F.col("large"), 1, q)).alias("_g"))
    often = listed.groupBy(block, "_g").agg(F.count(F.lit(1)).alias("_df"))
    own = F.when(F.length("small") < q, F.array(F.col("small"))).otherwise(_grams(F.col("small"), q, q))
    asked = small.where("small <> ''").select(block, "small").distinct().select(block, "small", F.explode(own).alias("_g")).join(often, [block, "_g"], "left")
    rare = asked.groupBy(block, "small").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_g").alias("g"))).alias("_x")).where("_x.df > 0").select(block, "small", F.col("_x.g").alias("_g"))
    return rare.join(listed, [block, "_g"]).where(F.contains("large", "small")).select(block, "small", "large")


def entity_names(entities: DataFrame) -> DataFrame:
    """(story, name, node, place): what entities of a story are called, in lower case.

    ``entities`` has story, entity, canonical, value, canonical_name and aliases. The node is the canonical entity, or the
    entity itself. Names come in the order of entities: the value, then, where there is a canonical name, that and its
    aliases. ``place`` tells where a name comes first; it means the node that it is given last.
    """
    names = F.concat(F.array("value"), F.when(F.col("canonical_name").isNotNull(), F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>")))
    one = entities.select("story", "entity", F.concat(F.lit("entity:"), F.coalesce("canonical", "entity").cast("string")).alias("node"), F.posexplode(names).alias("pos", "name")).where("name is not null and name <> ''")
    place = F.struct("entity", "pos")
    return one.select("story", F.lower("name").alias("name"), "node", place.alias("place")).groupBy("story", "name").agg(F.max_by("node", F.struct("place", "node")).alias("node"), F.min("place").alias("place"))


def locate(places: DataFrame, names: DataFrame) -> DataFrame:
    """(story, location, node): the entity that a location names, else the first one whose name is part of it or has it as a
    part. ``places`` has story and location; null and empty locations are nowhere."""
    p = places.where("location <> ''").select("story", "location", F.lower("location").alias("name")).distinct()
    exact = p.join(names.select("story", "name", "node"), ["story", "name"])
    rest = p.join(names.select("story", "name"), ["story", "name"], "left_anti")
    open_ = rest.select("story", "name").distinct()
    within = contained_in(names.select("story", F.col("name").alias("small")), open_.select("story", F.col("name").alias("large")), "story").select("story", F.col("large").alias("name"), F.col("small").alias("_n"))
    around = contained_in(open_.select("story", F.col("name").alias("small")), names.select("story", F.col("name").alias("large")), "story").select("story", F.col("small").alias("name"), F.col("large").alias("_n"))
    met = within.unionByName(around).join(names.select("story", F.col("name").alias("_n"), "node", "place"), ["story", "_n"])
    first = met.groupBy("story", "name").agg(F.min_by("node", "place").alias("node"))
    return exact.select("story", "location", "node").unionByName(rest.join(first, ["story", "name"]).select("story", "location", "node"))


def _tag(kind: str, c: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))


def graph_nodes(articles: DataFrame, events: DataFrame, entities: DataFrame, sources: DataFrame, tasks: int | None = None) -> DataFrame:
    """Nodes (story, node, label, kind) of all stories; see ``knowledge_graph``.

    Rows are dealt by story into ``tasks`` parts (else as Spark's settings say) before equal nodes meet, so that what a
    task holds does not follow the size of files; the result lies by story, and what is counted of stories is not dealt again.
    """
    known = articles.where("source is not null").join(sources.select("source", "name"), "source")
    none = F.lit(None).cast(entities.schema["entity"].dataType)
    rows = lambda df, node, label, kind, entity=none: df.select("story", node.alias("node"), label.alias("label"), F.lit(kind).alias("kind"), entity.alias("_e"))
    nodes = (rows(articles, _tag("article", "article"), F.coalesce("title", F.lit("Untitled Article")), "article")
             .unionByName(rows(known, _tag("source", "source"), F.col("name"), "source"))
             .unionByName(rows(events, _tag("event", "event"), F.coalesce("event_type", F.lit("EVENT")), "event"))
             .unionByName(rows(entities, F.concat(F.lit("entity:"), F.coalesce("canonical", "entity").cast("string")), F.coalesce("canonical_name", "value"), "entity", F.col("entity"))))
    nodes = nodes.repartition(tasks, "story") if tasks else nodes.repartition("story")
    first = F.struct("_e", (F.col("label").isNull() & (F.col("kind") != "entity")).alias("_none"), "label")  # the first entity's label, else the least
    return nodes.groupBy("story", "node", "kind").agg(F.min_by("label", first).alias("label")).select("story", "node", "label", "kind")


def _edges_of_names(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges (story, a, b, kind, role) between entities and events, where a story has many names: by inverted indexes."""
    names = cut(entity_names(entities))
    parts = events.select("story", "event", F.explode(F.array(F.struct(F.lit("actor").alias("role"), F.col("actors").alias("who")), F.struct(F.lit("target").alias("role"), F.col("targets").alias("who")))).alias("p"))
    parts = parts.select("story", "event", "p.role", F.explode("p.who").alias("who")).select("story", "event", "role", F.lower("who").alias("name")).join(names.select("story", "name", "node"), ["story", "name"])
    at = events.where("location <> ''").select("story", "event", "location").join(locate(events.select("story", "location"), names), ["story", "location"])
    parts = parts.select("story", F.col("node").alias("a"), _tag("event", "event").alias("b"), F.lit("participated_in").alias("kind"), "role")
    return parts.unionByName(at.select("story", _tag("event", "event").alias("a"), F.col("node").alias("b"), F.lit("located_at").alias("kind"), F.lit(None).cast("string").alias("role"))).distinct()


def _edges_of_few_names(events: DataFrame, entities: DataFrame) -> DataFrame:
    """The same where a story has few names: each of its events is held against all of them in one row, and no pairs or runs of
    letters are made. Entities and events are shuffled once, by story."""
    names = entity_names(entities.repartition("story")).groupBy("story").agg(F.collect_list(F.struct("name", "place", "node")).alias("_names"))
    x = events.select("story", "event", "actors", "targets", F.lower("location").alias("_at")).join(names, "story")
    none = F.lit(None).cast("string")
    edge = lambda a, b, kind, role: F.struct(a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"), role.alias("role"))
    event = _tag("event", "event")
    names_in = lambda who: F.filter("_names", lambda n: F.array_contains(F.transform(who, F.lower), n["name"]))
    parts = [F.transform(names_in("actors"), lambda n: edge(n["node"], event, "participated_in", F.lit("actor"))), F.transform(names_in("targets"), lambda n: edge(n["node"], event, "participated_in", F.lit("target")))]
    met = F.filter("_names", lambda n: (F.col("_at") != "") & (F.contains(F.col("_at"), n["name"]) | F.contains(n["name"], F.col("_at"))))
    first = F.array_min(F.transform(met, lambda n: F.struct((n["name"] != F.col("_at")).alias("part"), n["place"].alias("place"), n["node"].alias("node"))))["node"]
    at = F.transform(F.filter(F.array(first), lambda n: n.isNotNull()), lambda n: edge(event, n, "located_at", none))
    found = F.concat(*[F.coalesce(p, F.array().cast("array<struct<a:string,b:string,kind:string,role:string>>")) for p in (*parts, at)])
    return x.select("story", F.explode(found).alias("_x")).select("story", "_x.*").distinct()


def graph_edges(articles: DataFrame, events: DataFrame, entities: DataFrame, sources: DataFrame, few: int = 64) -> DataFrame:
    """Edges (story, a, b, kind, role) of all stories; see ``knowledge_graph``. Stories of up to ``few`` names are compared
    whole, the others by inverted indexes, with the same result."""
    known = articles.where("source is not null").select("story", "article", "source").join(sources.select("source").distinct(), "source", "left_semi").distinct()
    told = events.where("article is not null").select("story", "article", "event").join(articles.select("story", "article").distinct(), ["story", "article"], "left_semi").distinct()
    edge = lambda df, a, b, kind: df.select("story", a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("role"))
    many = cut(entities.groupBy("story").agg(F.sum(F.lit(2) + F.greatest(F.lit(0), F.coalesce(F.size("aliases"), F.lit(0)))).alias("_n")).where(F.col("_n") > few).select("story"))
    if many.limit(1).count():
        rest = [df.join(many, "story", "left_anti") for df in (events, entities)]
        named = _edges_of_few_names(*rest).unionByName(_edges_of_names(*[df.join(many, "story", "left_semi") for df in (events, entities)]))
    else:
        named = _edges_of_few_names(events, entities)
    return (edge(known, _tag("article", "article"), _tag("source", "source"), "reported_by")
            .unionByName(edge(told, _tag("article", "article"), _tag("event", "event"), "describes_event")).unionByName(named))


def knowledge_graph(articles: DataFrame, events: DataFrame, entities: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (story, node, label, kind) and edges (story, a, b, kind, role) of all stories at once.

    ``articles`` has story, article, title, source; ``events`` story, event, article, event_type, actors, targets, location;
    ``entities`` what ``entity_names`` takes; ``sources`` source, name. Edges: an article is reported_by a source and
    describes an event, an entity participated_in an event as actor or target, an event is located_at an entity.
    Edges to rows that are not there are dropped, and equal nodes and edges are listed once.
    """
    return graph_nodes(articles, events, entities, sources), graph_edges(articles, events, entities, sources)


def merge_stories(tables: dict[str, DataFrame], merges: DataFrame, story: str, unique: dict[str, list[str]], derived: list[str]) -> dict[str, DataFrame]:
    """``tables`` after stories are merged: ``merges`` has the story and its ``survivor``.

    Rows of a merged story move to the survivor. In a table of ``unique`` the story and the columns named there tell rows
    apart: a row that would be there twice is dropped, the survivor's own one first to stay, then that of the least
    story. Tables in ``derived`` are made again from others, so rows of merged stories go. A survivor that is itself
    merged passes its rows on to the end of the chain.
    """
    from .clustering import resolve_aliases

    m = merges.where(F.col(story) != F.col("survivor")).select(F.col(story).alias("alias"), F.col("survivor").alias("target"))
    ends = resolve_aliases(m.select(F.col("alias").alias(story)).distinct(), m, story).where(F.col(story) != F.col("target")).withColumnRenamed("target", "_to")
    out = {}
    for name, df in tables.items():
        if name in derived:
            out[name] = df.join(ends, story, "left_anti").select(df.columns)
            continue
        moved = df.join(ends, story, "left").withColumn("_from", F.when(F.col("_to").isNotNull(), F.col(story))).withColumn(story, F.coalesce("_to", story))
        if name in unique:
            row = F.struct(*df.columns)
            first = F.struct(F.col("_from").isNotNull(), "_from", F.to_json(row))
            out[name] = moved.groupBy(F.col(story).alias("_k"), *[F.col(c).alias(f"_k_{c}") for c in unique[name]]).agg(F.min_by(row, first).alias("_row")).select("_row.*")
        else:
            out[name] = moved.select(df.columns)
    return out
