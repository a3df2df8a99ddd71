"""Contact linkage: exact keys, guarded fuzzy names, groups with tiers, and field differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import block_letter, display_name, email_local_part, field_count, name_normal_form, name_score, normalize_email, normalize_phone, phone_last10, token_sorted
from ..storage import stage
from .components import connected_components
from .similar_text import close_texts

#: What a group says of itself: fixed values.
LARGE = "Large group of ", " — shared contact info may indicate a shared line, not duplicate people. Review carefully."
SURE, LIKELY = "Same phone number or email address", "Similar name with a related phone number or email"
NAME_LIMIT, TRUSTED = 0.90, 8


def contact_scan(raw: DataFrame) -> DataFrame:
    """``(contact_id, given, family, phones, emails, field_count)`` with normalised keys, blank ones dropped."""
    keys = lambda c, f: F.filter(F.transform(c, f), lambda x: x.isNotNull())
    return raw.select(
        "contact_id", F.coalesce("given", F.lit("")).alias("given"), F.coalesce("family", F.lit("")).alias("family"), keys("phones", lambda x: normalize_phone(x)).alias("phones"),
        keys("emails", lambda x: normalize_email(x)).alias("emails"), field_count(F.col("given"), F.col("family"), F.col("phones"), F.col("emails"), F.col("has_image")).alias("field_count"),
    )


def _star(keyed: DataFrame) -> DataFrame:
    """Edges from the smallest contact of each ``key`` to the others."""
    keyed = keyed.distinct()
    heads = keyed.groupBy("key").agg(F.min("contact_id").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(heads, "key").where("u <> contact_id").select("u", F.col("contact_id").alias("v")).distinct()


def phone_edges(contacts: DataFrame) -> DataFrame:
    return _star(contacts.select("contact_id", F.explode("phones").alias("key")))


def email_edges(contacts: DataFrame) -> DataFrame:
    return _star(contacts.select("contact_id", F.explode("emails").alias("key")))


def exact_edges(contacts: DataFrame) -> DataFrame:
    return phone_edges(contacts).union(email_edges(contacts)).distinct()


def _weak(keyed: DataFrame) -> DataFrame:
    """Pairs of contacts with an equal ``key`` under different ``full`` forms."""
    left = keyed.distinct()
    right = left.select(F.col("contact_id").alias("other"), "key", F.col("full").alias("other_full"))
    return left.join(right, "key").where("contact_id < other and full <> other_full").select(F.col("contact_id").alias("u"), F.col("other").alias("v")).distinct()


def weak_phone_pairs(contacts: DataFrame) -> DataFrame:
    """Pairs whose numbers share the last ten digits but not the whole form."""
    phones = contacts.select("contact_id", F.explode("phones").alias("full"))
    return _weak(phones.select("contact_id", "full", phone_last10(F.col("full")).alias("key")).where("key is not null"))


def weak_email_pairs(contacts: DataFrame) -> DataFrame:
    """Pairs whose addresses share the first part but not the whole."""
    emails = contacts.select("contact_id", F.explode("emails").alias("full"))
    return _weak(emails.select("contact_id", "full", email_local_part(F.col("full")).alias("key")).where("key is not null"))


def probable_edges(contacts: DataFrame, name_limit: float = NAME_LIMIT) -> DataFrame:
    """Weak pairs of one block letter whose names score ``name_limit`` or more, without the exact edges.

    A name alone never links, so the candidates are the equality joins of the weak signals.
    """
    facts = contacts.select("contact_id", display_name(F.col("given"), F.col("family")).alias("name"), block_letter(F.col("given"), F.col("family")).alias("letter"))
    side = lambda c: facts.select(F.col("contact_id").alias(c), F.col("name").alias(f"{c}_name"), F.col("letter").alias(f"{c}_letter"))
    pairs = weak_phone_pairs(contacts).union(weak_email_pairs(contacts)).distinct().join(side("u"), "u").join(side("v"), "v")
    pairs = pairs.where("u_letter = v_letter").where(name_score(F.col("u_name"), F.col("v_name")) >= name_limit).select("u", "v")
    return pairs.join(exact_edges(contacts), ["u", "v"], "left_anti")


def entries(contacts: DataFrame) -> DataFrame:
    """``(contact_id, of, full, key)``: each contact's distinct phones and emails with the weak key of each, or null; staged."""
    both = F.concat(F.transform("phones", lambda p: F.struct(F.lit("phone").alias("of"), p.alias("full"))), F.transform("emails", lambda e: F.struct(F.lit("email").alias("of"), e.alias("full"))))
    rows = contacts.select("contact_id", F.explode(both).alias("e")).select("contact_id", "e.of", "e.full")
    rows = rows.repartition("contact_id").distinct()  # dealt first, as one packed file may bring most contacts into one task
    return stage(rows.withColumn("key", F.when(F.col("of") == "phone", phone_last10(F.col("full"))).otherwise(email_local_part(F.col("full")))), "entries")


def weak_classes(entries: DataFrame, of: str) -> DataFrame:
    """``(contact_id, key, full, class_id, n_class, n_links)``: the pairs that share a weak key, as classes.

    A class holds the contacts of one full form under a key and is named by the smallest; ``n_class`` is their number.
    Every contact of a class is a weak pair with every other contact that has the key in another form; ``n_links`` is
    the number of those contacts. Keys with one form only have no pairs and no rows.
    """
    own = entries.where((F.col("of") == of) & F.col("key").isNotNull())
    classes = own.groupBy("key", "full").agg(F.min("contact_id").alias("class_id"), F.count("*").alias("n_class"))
    held = own.groupBy("key", "contact_id").agg(F.count("*").alias("forms"), F.min("full").alias("full"))
    alone = held.where("forms = 1").groupBy("key", "full").agg(F.count("*").alias("alone"))
    keys = held.groupBy("key").agg(F.count("*").alias("contacts"), F.max("forms").alias("most"), F.min("full").alias("least"), F.max("full").alias("last"))
    facts = classes.join(keys.where("most > 1 or least <> last"), "key").join(alone, ["key", "full"], "left")
    rows = own.join(facts, ["key", "full"]).join(held.select("key", "contact_id", "forms"), ["key", "contact_id"])
    links = F.col("contacts") - F.coalesce("alone", F.lit(0)) - (F.col("forms") > 1).cast("int")
    return rows.select("contact_id", "key", "full", "class_id", "n_class", links.alias("n_links"))


def name_links(contacts: DataFrame, found: DataFrame, name_limit: float = NAME_LIMIT) -> DataFrame:
    """``(of, key, letter, u, v)``: links of contacts with one weak key and block letter whose names score ``name_limit``.

    ``found`` is ``entries``. Every link is between names that score enough, and the links join the same contacts as all
    such pairs together; of equal names one contact is linked with the others, of close ones ``close_texts`` gives the
    links, so their number does not grow with the square of a common key.
    """
    normal = name_normal_form(display_name(F.col("given"), F.col("family")))
    facts = contacts.select("contact_id", block_letter(F.col("given"), F.col("family")).alias("letter"), normal.alias("plain"), token_sorted(normal).alias("sorted"))
    own = found.where("key is not null")
    weak = own.groupBy("of", "key").agg(F.min("full").alias("least"), F.max("full").alias("most")).where("least <> most").select("of", "key")
    keyed = own.join(weak, ["of", "key"], "left_semi").select("of", "key", "contact_id").distinct().join(facts, "contact_id")
    forms = F.explode(F.array(F.struct(F.lit("plain").alias("by"), F.col("plain").alias("form")), F.struct(F.lit("sorted").alias("by"), F.col("sorted").alias("form")))).alias("f")
    keyed = stage(keyed.select("of", "key", "letter", "contact_id", forms).select("of", "key", "letter", "f.by", "f.form", "contact_id"), "names")
    block = ["of", "key", "letter", "by"]
    heads = stage(keyed.groupBy(*block, "form").agg(F.min("contact_id").alias("head")), "heads")
    inside = keyed.join(heads, [*block, "form"]).where("contact_id <> head").select("of", "key", "letter", F.col("head").alias("u"), F.col("contact_id").alias("v"))
    head_of = lambda c: heads.select(*block, F.col("form").alias(c), F.col("head").alias(f"{c}_head"))
    across = close_texts(heads, block, "form", name_limit).join(head_of("a"), [*block, "a"]).join(head_of("b"), [*block, "b"]).where("a_head <> b_head")
    return inside.union(across.select("of", "key", "letter", F.least("a_head", "b_head"), F.greatest("a_head", "b_head"))).distinct()


def probable_classes(contacts: DataFrame, name_limit: float = NAME_LIMIT) -> DataFrame:
    """``(of, key, letter, contact_id, class_id)``: contacts of one weak key and block letter that close names join.

    A class is what a chain of names that score ``name_limit`` joins; its smallest contact names it. Only keys that occur
    in two full forms count; a contact without a partner has no row.
    """
    links = stage(name_links(contacts, entries(contacts), name_limit), "name-links")
    node = lambda c: F.to_json(F.struct("of", "key", "letter", F.col(c).alias("contact_id")))
    nodes = connected_components(links.select(node("u").alias("u"), node("v").alias("v")))
    nodes = nodes.select("component", F.from_json("node", "of string, key string, letter string, contact_id string").alias("n")).select("component", "n.*")
    names = nodes.groupBy("component").agg(F.min("contact_id").alias("class_id"))
    return nodes.join(names, "component").drop("component")


def probable_links(contacts: DataFrame, name_limit: float = NAME_LIMIT) -> DataFrame:
    """Edges that join the same groups as the exact and the probable ones together, without listing every pair.

    Where two names of a key have only one full form between them, an exact edge joins them anyway.
    """
    return name_links(contacts, entries(contacts), name_limit).select("u", "v").distinct()


def link_contacts(contacts: DataFrame, name_limit: float = NAME_LIMIT, trusted: int = TRUSTED) -> tuple[DataFrame, DataFrame]:
    """Groups ``(group_id, tier, confidence, match_reason, recommended_primary, n_members)`` and ``(group_id, contact_id)``."""
    found = entries(contacts)
    heads = found.groupBy("of", "full").agg(F.min("contact_id").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    exact = found.join(heads, ["of", "full"]).where("u <> contact_id").select("u", F.col("contact_id").alias("v"), F.lit(True).alias("exact"))
    edges = stage(exact.union(name_links(contacts, found, name_limit).select("u", "v", F.lit(False))), "links")
    members = connected_components(edges.select("u", "v")).select(F.col("component").alias("group_id"), F.col("node").alias("contact_id"))
    has_exact = edges.join(members, F.col("u") == F.col("contact_id")).groupBy("group_id").agg(F.bool_or("exact").alias("exact"))
    facts = members.join(contacts.select("contact_id", "field_count"), "contact_id")
    groups = facts.groupBy("group_id").agg(F.count("*").alias("n_members"), F.min(F.struct(-F.col("field_count"), F.col("contact_id").alias("item")))["item"].alias("recommended_primary"))
    groups = groups.join(has_exact, "group_id")
    large, sure = F.col("n_members") > trusted, F.col("exact")
    shared = F.concat(F.lit(LARGE[0]), F.col("n_members").cast("string"), F.lit(LARGE[1]))
    return groups.select(
        "group_id", F.when(~large & sure, "exact").otherwise("probable").alias("tier"), F.when(large, 0.375).when(sure, 1.0).otherwise(0.75).alias("confidence"),
        F.when(large, shared).when(sure, SURE).otherwise(LIKELY).alias("match_reason"),
        "recommended_primary", "n_members",
    ), members


def field_diffs(groups: DataFrame, members: DataFrame, raw: DataFrame) -> DataFrame:
    """``(group_id, contact_id, label, primary_value, other_value, is_loss)`` for each member but the primary.

    A name row is never a loss; a phone or email is one if only the other record has it.
    """
    others = members.join(groups.select("group_id", "recommended_primary"), "group_id").where("contact_id <> recommended_primary")
    name = F.concat_ws(" ", F.when(F.col("given") != "", F.col("given")), F.when(F.col("family") != "", F.col("family")))
    facts = raw.select("contact_id", F.when(name != "", name).alias("name"), F.coalesce("phones", F.array().cast("array<string>")).alias("phones"), F.coalesce("emails", F.array().cast("array<string>")).alias("emails"))
    primary = facts.select(F.col("contact_id").alias("recommended_primary"), F.struct("name", "phones", "emails").alias("p"))
    both = others.join(facts.select("contact_id", F.struct("name", "phones", "emails").alias("o")), "contact_id").join(primary, "recommended_primary")

    def values(label: str, field: str) -> DataFrame:
        value = F.explode(F.array_sort(F.array_union(f"p.{field}", f"o.{field}")))
        rows = both.select("group_id", "contact_id", "p", "o", value.alias("value"))
        of = lambda side: F.when(F.array_contains(f"{side}.{field}", F.col("value")), F.col("value"))
        return rows.select("group_id", "contact_id", F.lit(label).alias("label"), of("p").alias("primary_value"), of("o").alias("other_value"), of("p").isNull().alias("is_loss"))

    names = both.select("group_id", "contact_id", F.lit("Name").alias("label"), F.col("p.name").alias("primary_value"), F.col("o.name").alias("other_value"), F.lit(False).alias("is_loss"))
    return names.union(values("Phone", "phones")).union(values("Email", "emails"))
