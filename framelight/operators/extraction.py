"""Products, page contexts and further pages of a listing, from tables of page nodes.

Each element knows its ancestors, so that cards, sections and links are joins on (page_id, id): one between images and
their nearest ancestors, and aggregates of what lies below an ancestor."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.functions.lineage import cut, met
from framelight.functions.text import casefold, clean_text, is_noise_name
from framelight.operators.gate import dedupe_candidates
from framelight.functions.urls import absolute, bare, canonical_listing_url, is_paginated, match_url, same_origin
from framelight.sources.html import structured_products

# Patterns that tell page furniture, recommendations, product cards, files and actions.
FURNITURE = (
    r"(?i)footer|header|navbar|nav-bar|navigation|social|follow|share|app[-_ ]?store|google[-_ ]?play|play[-_ ]?store|app[-_ ]?download|download[-_ ]?app|mobile[-_ ]?app|"
    r"store[-_ ]?badge|app[-_ ]?badge|newsletter|subscribe|payment|copyright|legal|cookie|consent|contact[-_ ]?info|trust[-_ ]?badge|qr[-_ ]?code"
)
FURNITURE_URL = (
    r"(?i)facebook|instagram|linkedin|youtube|twitter|tiktok|whatsapp|pinterest|play\.google\.com|google[-_ ]?play|play[-_ ]?store|apps\.apple\.com|itunes\.apple\.com|app[-_ ]?store|"
    r"social|follow|logo|icon|badge|newsletter|subscribe|payment|visa|mastercard|qr[-_ ]?code"
)
RECOMMENDED = (
    r"(?i)related|recommend|recently[-_ ]?viewed|recent[-_ ]?products?|upsell|up[-_ ]?sell|cross[-_ ]?sell|similar|you[-_ ]?may[-_ ]?also[-_ ]?like|also[-_ ]?like|suggested|"
    r"featured[-_ ]?products?|people[-_ ]?also[-_ ]?bought"
)
CARD = r"(?i)product|catalog|listing|grid[-_ ]?item|woocommerce"
GENERIC_CARD = r"(?i)\b(card|tile|grid[-_ ]?cell|grid[-_ ]?item|catalog[-_ ]?item|item)\b"
PRODUCT_DATA = ["data-product-id", "data-product_id", "data-product", "data-sku", "data-product-sku"]
IMAGE_FILE = r"\.(?:jpe?g|png|webp|gif|svg|avif|bmp|tiff?)(?:$|[?#])"
ACTION_LINK = r"add[-_ ]?to[-_ ]?cart|wishlist|compare|quick[-_ ]?view|lightbox|login|account|cart|checkout|wp-content|uploads?/"
SOURCES = ["data-zoom-image", "data-large_image", "data-large-image", "data-original", "data-lazy-src", "data-src", "src"]
# Why an image is no product.
NO_PRODUCT = ["UI / website-chrome text", "UI / social / store-badge URL", "Image is inside footer/header/social/app UI"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
PAGER = r"(?i)pagination|pager|page-numbers|page_numbers|nav-links|nav_links|pages"
NEXT = ["next", "next page", "older", "›", "»", ">"]


def semantic(attrs: Column) -> Column:
    """Class, id, role, label and test id in one text."""
    return F.concat_ws(" ", *[F.nullif(attrs[k], F.lit("")) for k in ("class", "id", "role", "aria-label", "data-testid")])


def best_of_srcset(srcset: Column) -> Column:
    """The address of the greatest width (640w) or density (2x, as 2000); of equal ones the first."""

    def scored(part: Column) -> Column:
        bits = F.split(F.trim(part), r"\s+")
        last = F.get(bits, F.size(bits) - 1)
        number = F.regexp_extract(last, r"^(\d+)w$", 1).try_cast("double")
        density = F.regexp_extract(last, r"^([0-9.]+)x$", 1).try_cast("double") * 1000
        return F.struct(F.when(F.size(bits) > 1, F.coalesce(number, density, F.lit(1.0))).otherwise(1.0).alias("score"), F.get(bits, F.lit(0)).alias("url"))

    parts = F.transform(F.filter(F.split(srcset, ","), lambda p: F.trim(p) != ""), scored)
    start = F.struct(F.lit(-1.0).alias("score"), F.lit(None).cast("string").alias("url"))
    return F.aggregate(parts, start, lambda best, p: F.when(p["score"] > best["score"], p).otherwise(best))["url"]


def is_detail_url(page: Column, url: Column) -> Column:
    """Whether an absolute address may be a product's own page."""
    low = F.lower(url)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(low.rlike("^https?://") & same_origin(page, url) & ~low.rlike(IMAGE_FILE) & ~low.rlike(ACTION_LINK) & ~(url.contains("#") & ~url.endswith("#") & (F.trim(path, F.lit("/")) == "")), F.lit(False))


def names_beside(nodes: DataFrame, images: DataFrame) -> DataFrame:
    """page_id, id, near_name of those images (page_id, id, path) that have a name near them: of their six nearest ancestors the first that holds a
    heading (h1 to h5), else an element whose class has title or name, else is itself an article, a list item or a product-like division whose whole
    text will do. Of each kind only the first element below an ancestor counts, and texts of 4 to 180 characters that are no noise.

    Only ids of possible names are told to their ancestors, and only texts that were chosen are looked up."""
    a = F.col("attrs")
    fits = lambda text: F.length(text).between(4, 180) & ~is_noise_name(text)
    kinds = F.array(*[F.when(F.col("tag") == h, F.lit(i)) for i, h in enumerate(HEADINGS[:5])], *[F.when(F.coalesce(a["class"].contains(w), F.lit(False)), F.lit(5 + i)) for i, w in enumerate(("title", "name"))])
    named = nodes.select("page_id", "id", "path", F.explode(F.array_compact(kinds)).alias("kind"))
    first = named.select("page_id", F.explode("path").alias("up"), "kind", "id").groupBy("page_id", "up", "kind").agg(F.min("id").alias("at"))
    up = images.select("page_id", "id", F.posexplode(F.slice("path", 1, 6)).alias("depth", "up"))
    whole = (F.col("tag").isin("article", "li") | ((F.col("tag") == "div") & F.coalesce(a["class"].rlike("(?i)product|card|item|tile"), F.lit(False))))
    own = nodes.filter(whole).select("page_id", F.col("id").alias("up"), F.lit(7).alias("kind"), F.col("id").alias("at"))
    places = up.join(met(first.unionByName(own)), ["page_id", "up"]).select("page_id", "id", "depth", "kind", "at")
    texts = nodes.filter(whole | (F.size(F.array_compact(kinds)) > 0)).select("page_id", F.col("id").alias("at"), clean_text(F.col("text")).alias("text"))
    found = places.join(met(texts.filter(fits(F.col("text")))), ["page_id", "at"])
    return found.groupBy("page_id", "id").agg(F.min_by("text", F.struct("depth", "kind")).alias("near_name"))


def judged_images(nodes: DataFrame) -> DataFrame:
    """Named images of each page that may be products: page_id, pos, name, image_url, product_url, has_card, and the first reason why one is none (null: it may be one)."""
    a = F.col("attrs")
    src = F.coalesce(best_of_srcset(F.coalesce(*[F.nullif(a[k], F.lit("")) for k in ("srcset", "data-srcset", "data-lazy-srcset")])), *[F.nullif(a[k], F.lit("")) for k in SOURCES])
    small = lambda k: F.coalesce(a[k].try_cast("double") < 90, F.lit(False)) & (a[k] != "")
    images = nodes.filter("tag = 'img'").filter(~F.coalesce(small("width"), F.lit(False)) & ~F.coalesce(small("height"), F.lit(False)))
    images = images.select("page_id", "url", "id", "path", F.trim(src).alias("src"), clean_text(a["alt"]).alias("alt"), clean_text(a["title"]).alias("title")).filter("src IS NOT NULL AND src NOT LIKE 'data:%'")
    images = cut(images.withColumn("image_url", absolute("url", "src")).filter("image_url IS NOT NULL"))  # the joins below read them five times

    # what lies below each element: judged once for each node, then told to its ancestors
    named = F.coalesce(a["class"].rlike("title|name"), F.lit(False))
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    heads, text = F.col("tag").isin(*HEADINGS), clean_text(F.col("text"))
    facts = {"has_link": (F.col("tag") == "a") & a["href"].isNotNull(), "has_name": heads | named, "has_heading": F.col("tag").isin(*HEADINGS[1:])}
    told = nodes.select("page_id", "id", "path", *[c.alias(k) for k, c in facts.items()], F.when(heads, F.col("id")).alias("at"), F.when(heads, F.col("text")).alias("heading"))
    told = told.filter(reduce(or_, map(F.col, facts)))  # most elements have nothing to tell
    told = told.select(F.explode("path").alias("above"), *[c for c in told.columns if c not in ("id", "path")])
    features = told.groupBy("page_id", F.col("above").alias("id")).agg(*[has(k).alias(k) for k in facts], F.min_by("heading", "at").alias("heading"))
    elements = nodes.select("page_id", F.col("id").alias("up"), F.col("tag").alias("up_tag"), "attrs", semantic(a).alias("semantic")).join(met(features.withColumnRenamed("id", "up")), ["page_id", "up"], "left")

    # images and their nine nearest ancestors
    up = images.select("page_id", "id", F.posexplode(F.slice("path", 1, 9)).alias("depth", "up")).join(met(elements), ["page_id", "up"])
    marked = F.coalesce(F.exists(F.map_keys("attrs"), lambda k: k.isin(*PRODUCT_DATA)), F.lit(False))
    card = marked | F.col("semantic").rlike(CARD) | (F.col("semantic").rlike(GENERIC_CARD) & F.col("has_link") & F.col("has_name")) | (F.col("up_tag").isin("li", "article") & F.col("has_heading") & F.col("has_link"))
    furniture = (F.col("depth") < 8) & (F.col("up_tag").isin("footer", "header") | F.col("semantic").rlike(FURNITURE))
    other = F.col("semantic").rlike(RECOMMENDED) | (F.col("up_tag").isin("section", "aside") & F.coalesce(F.col("heading").rlike(RECOMMENDED), F.lit(False)))
    around = up.groupBy("page_id", "id").agg(F.min_by("up", F.when(card, F.col("depth"))).alias("card"), has(furniture).alias("furniture"), has(other).alias("other"))
    images = images.join(met(around), ["page_id", "id"], "left").filter(~F.coalesce("other", F.lit(False)))

    # links: the one around the image, and those of the card
    links = nodes.filter("tag = 'a' AND attrs['href'] IS NOT NULL").select("page_id", "url", F.col("id").alias("link"), "path", F.lower(semantic(a)).alias("semantic"), F.lower(clean_text(F.col("text"))).alias("label"), clean_text(F.col("text")).alias("text"), absolute("url", a["href"]).alias("to"))
    pictured = nodes.filter("tag = 'img'").select("page_id", F.explode("path").alias("link")).distinct().withColumn("has_img", F.lit(1))
    links = links.join(met(pictured), ["page_id", "link"], "left")
    depth = F.size(F.filter(F.split(F.regexp_extract("to", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != ""))
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = points(F.col("semantic").contains("product"), 5) + points(F.col("semantic").contains("woocommerce-loop-product"), 5) + points(F.col("semantic").contains("title"), 3) + points(F.coalesce(F.col("has_img"), F.lit(0)) == 1, 2)
    score = score + points((F.col("label") != "") & ~F.col("label").rlike("read more|learn more|view|details"), 1) + F.least(depth, F.lit(3))
    links = links.withColumn("score", score).withColumn("fine", is_detail_url(F.col("url"), F.col("to")))
    links = links.withColumn("away", F.when(F.col("fine"), canonical_listing_url("to") != canonical_listing_url("url")))
    links = cut(links.select("page_id", "link", "path", "label", "text", "to", "score", "fine", "away"))
    direct = images.select("page_id", "id", F.posexplode("path").alias("depth", "link")).join(met(links.select("page_id", "link", "to", "score", "fine", "away")), ["page_id", "link"])
    nearest = direct.groupBy("page_id", "id").agg(F.min_by(F.struct("to", "score", "fine", "away"), "depth").alias("direct"))
    name_fits = lambda text, most=220: (F.length(text) >= 4) & (F.length(text) <= most) & ~is_noise_name(text)
    call = F.col("label").rlike("add to cart|get a quote|quick view|compare|wishlist")
    fit = name_fits(F.col("text")) & ~call
    in_card = links.select("page_id", F.when(F.col("fine"), F.struct("score", F.length("to").alias("n"), "to")).alias("best"), F.when(fit, F.col("text")).alias("text"), F.when(fit, F.col("link")).alias("at"), "path").filter("best IS NOT NULL OR at IS NOT NULL")
    of_card = in_card.select("page_id", "best", "text", "at", F.explode("path").alias("card")).groupBy("page_id", "card").agg(F.max("best").alias("best"), F.min_by("text", "at").alias("link_name"))
    klass = F.coalesce(F.lower(a["class"]), F.lit(""))
    kind = F.when(klass.contains("title") & klass.contains("product"), 0).when(klass.contains("title"), 1).when(klass.contains("name") & klass.contains("product"), 2).when(klass.contains("name"), 3)
    kind = F.coalesce(kind, F.get(F.array(*[F.lit(4 + i) for i in range(6)]), F.array_position(F.array(*map(F.lit, HEADINGS)), F.col("tag")).cast("int") - 1))
    titled = nodes.select("page_id", "path", text.alias("text"), F.struct(kind.alias("kind"), "id").alias("at")).filter(F.col("at.kind").isNotNull() & name_fits(F.col("text")))
    titles = titled.select("page_id", F.explode("path").alias("card"), "text", "at").groupBy("page_id", "card").agg(F.min_by("text", "at").alias("title_name"))
    found = images.join(met(nearest), ["page_id", "id"], "left").join(met(of_card), ["page_id", "card"], "left").join(met(titles), ["page_id", "card"], "left")

    own = F.when((F.col("alt") != "") & ~is_noise_name(F.col("alt")) & (F.length("alt") >= 4), F.col("alt"))
    title = F.when((F.col("title") != "") & ~is_noise_name(F.col("title")), F.col("title"))
    found = found.join(met(names_beside(nodes, images.filter(F.col("card").isNull() & own.isNull() & title.isNull()).select("page_id", "id", "path"))), ["page_id", "id"], "left")
    name = F.coalesce(own, "title_name", "link_name", title, "near_name", F.lit("Unnamed product"))
    around_it = F.when(F.col("direct.fine"), F.struct(F.col("direct.score").alias("score"), F.length("direct.to").alias("n"), F.col("direct.to").alias("to")))
    has_card = F.col("card").isNotNull()
    recovered = F.when(F.col("direct.fine") & F.col("direct.away"), F.col("direct.to"))
    product_url = F.when(has_card, F.greatest(F.col("best"), around_it)["to"]).otherwise(F.coalesce(recovered, around_it["to"]))
    out = found.select("page_id", "url", F.col("id").alias("pos"), name.alias("name"), "image_url", product_url.alias("product_url"), has_card.alias("has_card"), "furniture", "alt", "title")
    searched = F.concat_ws(" ", "name", "image_url", F.coalesce("product_url", F.lit("")), "alt", "title")
    reason = F.when(is_noise_name(searched), NO_PRODUCT[0]).when(searched.rlike(FURNITURE_URL), NO_PRODUCT[1]).when(F.coalesce("furniture", F.lit(False)), NO_PRODUCT[2])
    return out.withColumn("reason", reason).select("page_id", "pos", "name", "image_url", "product_url", "has_card", "reason")


def rejected_images(nodes: DataFrame) -> DataFrame:
    """The images of each page that are no products, and why."""
    return judged_images(nodes).filter("reason IS NOT NULL").select("page_id", "pos", "image_url", "reason")


def dom_products(nodes: DataFrame, strict: bool = True) -> DataFrame:
    """Candidates of each page: page_id, pos, name, image_url, product_url, page_membership_method and _confidence."""
    out = judged_images(nodes).filter("reason IS NULL")
    method = F.when(F.col("has_card"), "catalog_card").when(F.col("product_url").isNotNull() & (F.col("name") != "Unnamed product"), "strong_product_link_recovery")
    sure = F.when(F.col("has_card") & F.col("product_url").isNotNull(), "high").when(method.isNotNull(), "medium").otherwise("low")
    out = out.withColumn("page_membership_method", method).withColumn("page_membership_confidence", sure)
    out = out.filter("page_membership_method IS NOT NULL") if strict else out.fillna({"page_membership_method": "legacy_dom"})
    return out.select("page_id", "pos", "name", "image_url", "product_url", "page_membership_method", "page_membership_confidence")


def enriched(products: DataFrame, structured: DataFrame) -> DataFrame:
    """products with names and addresses of structured data for the same product (by address, else by image; of several the last). Structured
    data adds no product; its name counts if longer or if there was none, its address if there was none."""
    image = lambda c: casefold(F.split(F.coalesce(c, F.lit("")), "#")[0])
    last = lambda key, name: structured.withColumn(f"{name}_key", key).filter(F.col(f"{name}_key") != "").groupBy("page_id", f"{name}_key").agg(F.max_by(F.struct("name", "product_url"), "at").alias(name))
    keyed = products.withColumn("product_key", bare(F.col("product_url"))).withColumn("image_key", image(F.col("image_url")))
    rows = keyed.join(met(last(bare(F.col("product_url")), "product")), ["page_id", "product_key"], "left").join(met(last(image(F.col("image_url")), "image")), ["page_id", "image_key"], "left")
    match = F.coalesce("product", "image")
    theirs = match["name"]
    better = (theirs != "") & (theirs != "Unnamed product") & ((F.col("name") == "Unnamed product") | (F.length(theirs) > F.length("name")))
    out = {"name": F.when(better, theirs).otherwise(F.col("name")), "product_url": F.coalesce(F.nullif("product_url", F.lit("")), match["product_url"])}
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in products.columns], match.isNotNull().alias("structured_data_match"))


def scrape(nodes: DataFrame, strict: bool = True) -> DataFrame:
    """strict: products of the page's own markup, which structured data only enriches. Else structured products come first, then those of the
    markup, one for each address (page_membership_* are null for structured ones)."""
    structured, found = structured_products(nodes), dom_products(nodes, strict)
    if strict:
        return enriched(found, structured)
    first = structured.withColumn("pos", F.col("at") - F.lit(1 << 40)).select(*[F.col(c) if c in (*structured.columns, "pos") else F.lit(None).cast("string").alias(c) for c in found.columns])
    both = first.withColumn("structured_data_match", F.lit(True)).unionByName(found.withColumn("structured_data_match", F.lit(False)))
    return dedupe_candidates(both)


def single_products(nodes: DataFrame) -> DataFrame:
    """The product of each page that is a product's own: of its structured data the one with the page's address, else the first; without any the
    first heading and the page's preview image; else the first image that the non-strict extraction finds. Pages with none give no row."""
    pages = nodes.select("page_id", "url").distinct()
    told = structured_products(nodes).join(met(pages), "page_id")
    told = told.select("page_id", (match_url(F.col("product_url")) != match_url(F.col("url"))).cast("int").alias("far"), "at", "name", "image_url", F.coalesce("product_url", "url").alias("product_url"), F.lit("single_product_jsonld").alias("source"), F.lit("high").alias("sure"), F.lit(0).alias("way"))
    heading = nodes.filter("tag = 'h1'").groupBy("page_id").agg(F.min_by(clean_text(F.col("text")), "id").alias("h1"))
    preview = nodes.filter("tag = 'meta' AND attrs['property'] = 'og:image'").groupBy("page_id", "url").agg(F.min_by(F.col("attrs")["content"], "id").alias("content")).filter("content <> ''").join(met(heading), "page_id", "left")
    none = F.lit(0).cast("long")
    preview = preview.select("page_id", F.lit(0).alias("far"), none.alias("at"), F.coalesce(F.nullif("h1", F.lit("")), F.lit("Unnamed product")).alias("name"), absolute("url", "content").alias("image_url"), F.col("url").alias("product_url"), F.lit("single_product_og").alias("source"), F.lit("medium").alias("sure"), F.lit(1).alias("way"))
    seen = dom_products(nodes, strict=False).join(met(pages), "page_id").join(met(heading), "page_id", "left")
    seen = seen.select("page_id", F.lit(0).alias("far"), F.col("pos").cast("long").alias("at"), F.coalesce(F.nullif("h1", F.lit("")), "name").alias("name"), "image_url", F.coalesce("product_url", "url").alias("product_url"), F.lit("single_product_dom").alias("source"), F.lit("medium").alias("sure"), F.lit(2).alias("way"))
    best = told.unionByName(preview).unionByName(seen).groupBy("page_id").agg(F.min(F.struct("way", "far", "at", "name", "image_url", "product_url", "source", "sure")).alias("b"))
    return best.select("page_id", "b.name", "b.image_url", "b.product_url", "b.source", F.col("b.sure").alias("page_membership_confidence"), F.lit("explicit_product_page").alias("page_membership_method"))


def page_contexts(nodes: DataFrame) -> DataFrame:
    """page_id and page_context: address, title, three h1 and eight breadcrumbs or collection titles at most, each text once."""
    a, text = F.col("attrs"), clean_text(F.col("text"))
    crumb = F.coalesce(a["class"].rlike("(?i)breadcrumb|collection[-_ ]?title|category[-_ ]?title|page[-_ ]?title"), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("id"))
    kinds = nodes.select("page_id", "id", "tag", text.alias("text"), crumb.alias("crumb"), semantic(a).rlike(r"(?i)product[-_ ]?(card|item|tile)|grid[-_ ]?item|catalog[-_ ]?item").alias("of_card"))
    rows = kinds.select("page_id", "id", "text", "of_card", F.explode(F.array_compact(F.array(F.when(F.col("tag") == "title", 1), F.when(F.col("tag") == "h1", 2), F.when(F.col("crumb"), 3)))).alias("kind")).withColumn("nth", nth)
    rows = rows.filter("nth <= CASE kind WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 8 END AND NOT (kind = 3 AND of_card) AND text <> ''")
    urls = nodes.select("page_id", clean_text(F.col("url")).alias("text")).distinct().select("page_id", F.lit(0).alias("kind"), F.lit(0).alias("id"), "text")
    rows = rows.select("page_id", "kind", "id", "text").unionByName(urls).withColumn("same", casefold("text"))
    first = rows.groupBy("page_id", "same").agg(F.min(F.struct("kind", "id", "text")).alias("t"))
    return first.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["text"]), " | ").alias("page_context"))


def pagination_links(nodes: DataFrame) -> DataFrame:
    """page_id, pos, link: further pages of the same listing, each once: links that say next, page-like ones in a pager, and page-like ones
    with a number or next as their text.

    Nodes are read once: only pagers, and links that one of the three ways could take, go on to the joins."""
    a = F.col("attrs")
    is_pager = F.col("tag").isin("nav", "div", "ul", "ol") & F.concat_ws(" ", *[a[k] for k in ("class", "id", "aria-label", "role")]).rlike(PAGER)
    links = nodes.filter((F.col("tag") == "a") & F.coalesce(a["href"] != "", F.lit(False)) | F.coalesce(is_pager, F.lit(False))).select("page_id", "url", "id", "path", (F.col("tag") != "a").alias("is_pager"), F.lower(clean_text(F.col("text"))).alias("label"), F.lower(F.coalesce(a["rel"], F.lit(""))).alias("rel"), absolute("url", a["href"]).alias("to"))
    says_next = F.array_contains(F.split("rel", r"\s+"), "next")
    told = F.col("label").rlike(r"^\d+$") | F.col("label").isin(*NEXT)
    links = links.select("*", says_next.alias("says_next"), told.alias("told"), F.coalesce(is_paginated(F.col("to")), F.lit(False)).alias("paged"), F.coalesce(same_origin(F.col("url"), F.col("to")), F.lit(False)).alias("same"))
    links = cut(links.filter("is_pager OR (same AND (says_next OR told OR paged))").drop("label", "rel"))
    pager, links = links.filter("is_pager").select("page_id", F.col("id").alias("up")), links.filter("NOT is_pager")
    inside = links.select("page_id", "id", F.explode("path").alias("up")).join(met(pager), ["page_id", "up"]).groupBy("page_id", "id").agg(F.min("up").alias("pager"))
    order = F.array_compact(F.array(
        F.when(F.col("says_next"), F.struct(F.lit(0).alias("way"), F.lit(0).alias("of"), "id")),
        F.when(F.col("pager").isNotNull() & (F.col("told") | F.col("paged")), F.struct(F.lit(1).alias("way"), F.col("pager").alias("of"), "id")), F.when(F.col("paged") & F.col("told"), F.struct(F.lit(2).alias("way"), F.lit(0).alias("of"), "id")),
    ))
    rows = links.join(met(inside), ["page_id", "id"], "left").select("page_id", canonical_listing_url("url").alias("own"), canonical_listing_url("to").alias("link"), F.array_min(order).alias("place"))
    rows = rows.filter("place IS NOT NULL AND link <> own").groupBy("page_id", "link").agg(F.min("place").alias("place"))
    return rows.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("place")).alias("pos"), "link")


def crawl(start: DataFrame, web: DataFrame, most: int = 25) -> DataFrame:
    """listing_id, url, pos, page_number: pages reached from start (listing_id, url) over web (url, links array), by breadth, ``most`` for
    each listing; hops are joins of the frontier, and stop when none is new. A page stands after those that were found before it: by hop, by
    the rank of the page that links to it, and by the link's place there. Of addresses that lead to one page (``web`` may have a final_url, see
    sources.responses) the first counts; a page that could not be fetched is not in web and counts as none where final_url is given.

    A listing's frontier and what it has seen are 4 * most addresses at most."""
    from framelight.functions.urls import page_number

    if "final_url" in web.columns:
        return crawl_fetched(start, web, most)
    seen = start.select("listing_id", canonical_listing_url("url").alias("url"), F.lit(0).alias("hop"), F.lit(1).alias("rank")).dropDuplicates(["listing_id", "url"])
    links = F.transform("links", lambda to: canonical_listing_url(to))
    seen, web = cut(seen), cut(web.select(canonical_listing_url("url").alias("url"), links.alias("links")).dropDuplicates(["url"]))  # each hop reads them
    within = Window.partitionBy("listing_id").orderBy("place", "url")
    frontier = seen
    for hop in range(1, most):
        new = frontier.join(met(web), "url").select("listing_id", "rank", F.posexplode("links").alias("at", "to"))
        new = new.select("listing_id", F.col("to").alias("url"), F.struct("rank", "at").alias("place")).groupBy("listing_id", "url").agg(F.min("place").alias("place"))
        new = new.join(met(seen.select("listing_id", "url")), ["listing_id", "url"], "left_anti").withColumn("rank", F.row_number().over(within))
        frontier = new.filter(F.col("rank") <= most).select("listing_id", "url", F.lit(hop).alias("hop"), "rank")  # more never count
        frontier = cut(frontier)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    pos = F.row_number().over(Window.partitionBy("listing_id").orderBy("hop", "rank")) - 1
    return seen.withColumn("pos", pos).filter(F.col("pos") < most).select("listing_id", "url", "pos", page_number(F.col("url")).alias("page_number"))


def crawl_fetched(start: DataFrame, web: DataFrame, most: int) -> DataFrame:
    """crawl over pages that were fetched: web (url, final_url, links). Addresses are visited in the order in which they were queued, hop by hop; one whose page was
    found already gives none; links are queued while a listing has fewer than 4 * most addresses visited or waiting."""
    from framelight.functions.urls import page_number

    room = 4 * most
    web = cut(web.select(canonical_listing_url("url").alias("url"), canonical_listing_url("final_url").alias("page"), "links").dropDuplicates(["url"]))
    queue = cut(start.select("listing_id", canonical_listing_url("url").alias("url"), F.lit(0).alias("hop"), F.lit(1).alias("rank")).dropDuplicates(["listing_id", "url"]))
    asked, found, hop = queue.select("listing_id", "url"), None, 0  # every address that was ever queued, and every page
    in_order = Window.partitionBy("listing_id").orderBy("hop", "rank")
    while not queue.isEmpty():
        pages = queue.join(met(web), "url").withColumn("nth", F.row_number().over(Window.partitionBy("listing_id", "page").orderBy("rank"))).filter("nth = 1").drop("nth")
        if found is not None:
            pages = pages.join(met(found.select("listing_id", "page")), ["listing_id", "page"], "left_anti")
        pages = cut(pages)
        new = pages.select("listing_id", "page", "hop", "rank")
        found = cut((new if found is None else found.unionByName(new)).withColumn("pos", F.row_number().over(in_order) - 1).filter(F.col("pos") < most).drop("pos"))
        went = pages.join(met(found), ["listing_id", "page", "hop", "rank"], "left_semi").select("listing_id", "rank", F.posexplode("links").alias("at", "to"))
        hop += 1
        links = went.select("listing_id", canonical_listing_url("to").alias("url"), F.struct("rank", "at").alias("place")).filter("url IS NOT NULL").groupBy("listing_id", "url").agg(F.min("place").alias("place"))
        links = links.join(met(asked), ["listing_id", "url"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("listing_id").orderBy("place", "url")))
        left = asked.groupBy("listing_id").agg((F.lit(room) - F.count(F.lit(1))).alias("left"))
        full = found.groupBy("listing_id").count().filter(F.col("count") >= most).select("listing_id")  # listings that have all their pages
        queue = cut(links.join(met(left), "listing_id").filter(F.col("rank") <= F.col("left")).join(met(full), "listing_id", "left_anti").select("listing_id", "url", F.lit(hop).alias("hop"), "rank"))
        asked = cut(asked.unionByName(queue.select("listing_id", "url")))
    none = start.sparkSession.createDataFrame([], start.select("listing_id").schema.add("page", "string").add("hop", "integer").add("rank", "integer"))
    pos = (none if found is None else found).withColumn("pos", F.row_number().over(in_order) - 1)
    return pos.select("listing_id", F.col("page").alias("url"), "pos", page_number(F.col("page")).alias("page_number"))
