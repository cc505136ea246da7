"""Row families of one transaction: aliases, carriers, companions, headers and link chains, and what proves them.

Rows of a family meet by equality joins and grouped counts on their transaction (master), never in one task's memory.
A null in a key column takes part in nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import wide_sum
from ledgerloom.operators.dispositions import resolve_links


def _found(check: str, rows: DataFrame, *key: str) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.concat_ws(":", *(F.col(k).cast("string") for k in key)).alias("key"))


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Rows aimed at in a task of a join or grouping whose keys hardly repeat.
DEALT = 1 << 20


def _dealer(*frames: DataFrame) -> Callable[..., DataFrame]:
    """A function that deals a frame by its key columns into as many partitions as the counted rows of all frames ask for.

    Keys that rise with the rows compress so well that partitions of equal bytes hold many times that in memory, and a sum of
    each key before the shuffle saves nothing where keys hardly repeat.
    """
    parts = max(1, -(-sum(f.count() for f in frames) // DEALT))
    return lambda df, *key: df.repartition(parts, *key)


def _net() -> Column:
    return F.coalesce(wide_sum(F.col("cents")), F.lit(0))


def alias_violations(aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """(check, key) of forwarding aliases (page, record, to_page, to_record) against the retained rows (page, record, is_posting).

    An alias leads elsewhere than to itself, from a place that no row and no other alias holds, to a posting row that no
    other alias leads to; so chains of aliases cannot be.
    """
    here, there = ["page", "record"], ["to_page", "to_record"]
    target = rows.select(F.col("page").alias("to_page"), F.col("record").alias("to_record"), "is_posting")
    deal = _dealer(aliases, rows)
    led = deal(aliases, *there)
    met = led.join(deal(target, *there), there, "left")
    left = deal(aliases, *here)
    return _union(
        _found("self_alias", aliases.where("page = to_page and record = to_record"), *here),
        _found("source_is_retained", left.join(deal(rows.select(*here), *here), here, "left_semi"), *here),
        _found("duplicate_source", left.groupBy(*here).count().where("count > 1"), *here),
        _found("duplicate_destination", led.groupBy(*there).count().where("count > 1"), *there),
        _found("no_posting_there", met.where("coalesce(is_posting, false) = false"), *here),
    )


def bill_families(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(master, date, view): masters with a header (headers: master) whose rows (master, target, account, date, view, cents) are
    proven: two or more, of two accounts or more, distinct targets, one date and view, no zero, and they net to nothing."""
    each = rows.groupBy("master").agg(
        F.count("*").alias("n"), F.countDistinct("target").alias("targets"), F.countDistinct("account").alias("accounts"), F.min("date").alias("date"), F.max("date").alias("d2"),
        F.min("view").alias("view"), F.max("view").alias("v2"), F.count_if(F.coalesce(F.col("cents"), F.lit(0)) == 0).alias("zeros"), _net().alias("net"),
    )
    good = each.where("n >= 2 and targets = n and accounts >= 2 and date = d2 and view = v2 and zeros = 0 and net = 0")
    return good.join(headers.select("master").distinct(), "master", "left_semi").select("master", "date", "view")


def is_bill_carrier() -> Column:
    """Whether a row is a non-posting carrier: no account, no amount, flags split and payable set, source, no-post and memorized not."""
    off = [~F.coalesce(F.col(c), F.lit(True)) for c in ("is_source", "is_no_post", "is_memorized")]
    on = [F.coalesce(F.col(c), F.lit(False)) for c in ("is_split", "is_arap")]
    return reduce(lambda a, b: a & b, [F.col("account").isNull(), F.col("cents").isNull(), *off, *on])


def bill_carrier_targets(carriers: DataFrame, rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(target): carriers (target, master, next, sibling, date, view, flags) whose chain of next links ends in a monetary row.

    A carrier's target is held by no row and no other carrier. Its family must be proven, in the same date and view, with
    its sibling among the family's accounts. It leads to a row of the family whose target is unique, or to another carrier
    of the same family, sibling and context; whatever ends elsewhere or runs in a cycle is left out.
    """
    own = carriers.where(is_bill_carrier())
    single = carriers.groupBy("target").count().where("count = 1").select("target")
    held = rows.groupBy("target").agg(F.count("*").alias("held"), F.min("master").alias("holder"))
    nodes = own.join(single, "target", "left_semi").join(held.select("target"), "target", "left_anti")
    nodes = nodes.join(bill_families(rows, headers), ["master", "date", "view"], "left_semi")
    nodes = nodes.join(rows.select("master", F.col("account").alias("sibling")).distinct(), ["master", "sibling"], "left_semi")
    nodes = nodes.select("target", "master", "next", "sibling")
    monetary = held.where("held = 1").select(F.col("target").alias("next"), "holder")
    onward = nodes.select(F.col("target").alias("next"), F.col("master").alias("m2"), F.col("sibling").alias("s2"))
    links = nodes.join(monetary, "next", "left").join(onward, "next", "left")
    to_row = F.coalesce(F.col("holder") == F.col("master"), F.lit(False))
    to_carrier = F.coalesce((F.col("m2") == F.col("master")) & (F.col("s2") == F.col("sibling")), F.lit(False))
    chain = links.select("master", F.col("target").alias("node"), F.when(~to_row & to_carrier, F.col("next")).alias("next"), to_row.alias("is_terminal"))
    return resolve_links(chain).where("terminal is not null").select(F.col("node").alias("target"))


def zero_terminals(carriers: DataFrame, rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(target): the only carrier of a master whose two rows are zeros that name each other.

    Both rows share date and view with the carrier and have flags as a carrier's; one is the source, the other not. The
    source leads to the other's target, the other to the carrier's; each names the other's account as its sibling, and the
    carrier, without account and next link, names the source's.
    """
    flags = "not is_no_post and not is_memorized and is_split and is_arap"
    pair = rows.groupBy("master").agg(F.count("*").alias("n"), F.count_if(F.expr(f"cents = 0 and {flags}")).alias("good")).where("n = 2 and good = 2").select("master")
    unique = rows.groupBy("target").count().where("count = 1").select("target")
    own = rows.join(pair, "master", "left_semi").join(unique, "target", "left_semi")
    pick = lambda prefix, source: own.where(F.col("is_source") == source).select("master", "date", "view", *(F.col(c).alias(f"{prefix}_{c}") for c in ("target", "account", "next", "sibling")))
    both = pick("a", True).join(pick("b", False), ["master", "date", "view"])
    alone = carriers.groupBy("master").count().where("count = 1").select("master")
    last = carriers.where(f"account is null and next is null and coalesce(cents, 0) = 0 and not is_source and {flags}").join(alone, "master", "left_semi")
    last = last.join(rows.select("target").distinct(), "target", "left_anti").join(headers.select("master").distinct(), "master", "left_semi")
    met = both.join(last.select("master", "date", "view", "target", "sibling"), ["master", "date", "view"])
    return met.where(
        "a_account <> b_account and a_target <> b_target and a_next = b_target and b_next = target and a_sibling = b_account and b_sibling = a_account and sibling = a_account"
    ).select("target")


def check_violations(rows: DataFrame, companions: DataFrame, sources: DataFrame, accounts: DataFrame) -> DataFrame:
    """(check, key) of a check table as a whole.

    rows (target, master, date, account, cents) are postings and zeros; companions (target, master) belong to voided checks,
    whose master has exactly two zeros and no amount; sources (target, master, date, next, sibling) are compact links: next
    is a posting of the same master and date, of another account than the sibling, which also has a row there; both accounts
    are known (accounts: account). All targets are distinct, also across the three, and masters net to nothing.
    """
    every = _union(*(f.select("target") for f in (rows, companions, sources)))
    deal = _dealer(rows, sources)
    masters = deal(rows, "master").groupBy("master").agg(F.count_if(F.col("cents") == 0).alias("zeros"), F.count_if(F.col("cents") != 0).alias("amounts"), _net().alias("net"))
    void = deal(companions, "master").join(masters, "master", "left")
    posting = deal(rows, "target").where("cents <> 0").select(F.col("target").alias("next"), F.col("master").alias("m"), F.col("date").alias("d"), F.col("account").alias("a"))
    onward = deal(sources, "next")
    led = onward.join(posting, "next", "left").withColumn("good", F.expr("coalesce(m = master and d = date and a <> sibling, false)"))
    known = accounts.select(F.col("account").alias("sibling")).distinct()
    of = ["master", "date", "sibling"]
    sides = deal(led.where("good"), *of).join(deal(rows.select("master", "date", F.col("account").alias("sibling")), *of), of, "left_anti")
    dates = deal(sources.select("master", "target", F.col("date").alias("d")), "master").join(deal(rows.select("master", "date"), "master").distinct(), "master").where("date <> d").select("target").distinct()
    return _union(
        _found("duplicate_target", deal(every, "target").groupBy("target").count().where("count > 1"), "target"),
        _found("unbalanced_check", masters.where("net <> 0"), "master"),
        _found("companion_repeats", companions.groupBy("master").count().where("count > 1"), "master"),
        _found("companion_without_void", void.where("not coalesce(zeros = 2 and amounts = 0, false)"), "target"),
        _found("link_leads_nowhere", led.where("not good"), "target"),
        _found("link_repeats", onward.groupBy("next").count().where("count > 1"), "next"),
        _found("sibling_absent", sides, "target"), _found("sibling_of_another_day", dates, "target"),
        _found("unknown_sibling", sources.join(known, "sibling", "left_anti"), "target"),
    )


def check_dispositions(rows: DataFrame, companions: DataFrame, sources: DataFrame) -> DataFrame:
    """(target, disposition) once `check_violations` finds nothing: companions and links are sources."""
    own = rows.select("target", F.when(F.col("cents") == 0, "canonical_zero").otherwise("posting").alias("disposition"))
    rest = _union(*(f.select("target", F.lit("source").alias("disposition")) for f in (companions, sources)))
    return own.unionByName(rest)


#: Envelopes of deposit rows: headers with three further rows and with one, the linked row and its counterparts.
DEPOSIT = {"wide": 0x70, "narrow": 0x71, "linked": 0xE1, "counterpart": 0xF1}


def deposit_headers(rows: DataFrame) -> DataFrame:
    """(master, outcome) of deposits with a header row: header if it stands as it must, else broken.

    rows: master, target, envelope, account, cents, is_source, is_no_post, is_memorized, is_split. One header a master,
    without account, amount, or flags but split, which a wide header has and a narrow one not. A wide header stands beside a
    linked source and two counterparts, all split, that net to nothing; a narrow one beside one linked source with an account
    and no amount, not split.
    """
    e = F.col("envelope")
    head, linked, other = e.isin(DEPOSIT["wide"], DEPOSIT["narrow"]), e == DEPOSIT["linked"], e == DEPOSIT["counterpart"]
    wide = e == DEPOSIT["wide"]
    bare = F.expr("account is null and cents is null and not is_source and not is_no_post and not is_memorized")
    paid = F.expr("account is not null and cents is not null and cents <> 0 and not is_no_post and not is_memorized")
    each = rows.groupBy("master").agg(
        F.count("*").alias("n"), F.count_if(head).alias("heads"), F.max(wide.cast("int")).alias("wide"), F.count_if(head & bare & (F.col("is_split") == wide)).alias("plain"),
        F.count_if(linked & paid & F.expr("is_source and is_split")).alias("links"), F.count_if(other & paid & F.expr("not is_source and is_split")).alias("others"),
        F.count_if(linked & F.expr("is_source and not is_split and cents is null and account is not null and not is_no_post and not is_memorized")).alias("bare_links"), _net().alias("net"),
    ).where("heads > 0")
    good = F.expr("heads = 1 and plain = 1 and ((wide = 1 and n = 4 and links = 1 and others = 2 and net = 0) or (wide = 0 and n = 2 and bare_links = 1))")
    return each.select("master", F.when(good, "header").otherwise("broken").alias("outcome"))


def journal_witnesses(sources: DataFrame, headers: DataFrame) -> DataFrame:
    """(target, outcome): journal source rows (target, master, date, group) against header rows (id, date, group).

    A source is proven if exactly one header has its date and group, and that header's id follows its master.
    """
    n = headers.groupBy("date", "group").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    both = sources.join(n, ["date", "group"], "left")
    outcome = F.when(F.col("n").isNull(), "no_header").when(F.col("n") > 1, "several_headers").when(F.col("id") == F.col("master") + 1, "proven").otherwise("other_master")
    return both.select("target", outcome.alias("outcome"))


#: Numbers of nodes that a chain of auxiliary rows may have.
CHAIN = (2, 4, 6)


def auxiliary_chains(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(master, date, view, outcome) of auxiliary rows (master, date, view, target, next, account), grouped by their context.

    rows: postings and zeros (master, date, view, target, account, cents). A single node is `metadata` if exactly one row
    of its context has its account. Several are a `chain` if they are 2, 4 or 6, one node has no predecessor, each other
    exactly one, the last one leads to a row of the context, every node leads there, and the master nets to nothing.
    All else is `broken`.
    """
    key = ["master", "date", "view"]
    sizes = nodes.groupBy(*key).agg(F.count("*").alias("n"))
    # only contexts of so few nodes are gathered; links inside one are then followed in its row
    few = nodes.join(sizes.where(F.col("n").isin(1, *CHAIN)), key)
    each = few.groupBy(*key, "n").agg(F.collect_list(F.struct("target", "next")).alias("own"), F.min("account").alias("alone"))
    each = each.withColumns({"targets": F.col("own.target"), "nexts": F.col("own.next")}).drop("own")
    # of the rows of a context: the nodes that lead to one, as bits, and how many have the single node's account
    met = rows.select(*key, "target", "account").join(each.select(*key, "nexts", "alone"), key).withColumn("at", F.array_position("nexts", F.col("target")))
    met = met.groupBy(*key).agg(F.bit_or(F.expr("CASE WHEN at > 0 THEN shiftleft(1, cast(at as int) - 1) ELSE 0 END")).alias("ends"), F.count_if(F.col("account") == F.col("alone")).alias("met"))
    led = each.join(met, key, "left").withColumns({"ends": F.coalesce("ends", F.lit(0)), "met": F.coalesce("met", F.lit(0))})
    led = led.withColumn("to", F.expr("transform(nexts, (x, i) -> CASE WHEN getbit(ends, i) = 1 THEN i + 1 ELSE cast(coalesce(array_position(targets, x), 0) as int) END)"))
    for _ in range((max(CHAIN) - 1).bit_length()):  # pointers double; 0 leads nowhere
        led = led.withColumn("to", F.expr("transform(to, p -> coalesce(get(to, p - 1), 0))"))
    reached = F.expr("array_max(to) > 0 and array_min(to) = array_max(to) and ends = shiftleft(1, array_max(to) - 1)")
    whole = lambda c: ~F.exists(c, lambda x: x.isNull()) & (F.size(F.array_distinct(c)) == F.col("n"))
    led = led.select(*key, ((F.col("n") == 1) & (F.col("met") == 1)).alias("single"), (F.col("n").isin(*CHAIN) & whole("targets") & whole("nexts") & reached).alias("path"))
    off = rows.groupBy("master").agg(_net().alias("net")).where("net <> 0").select("master", F.lit(True).alias("off"))
    led = led.where("single or path").join(off, "master", "left")
    found = led.select(*key, F.expr("CASE WHEN single THEN 'metadata' WHEN off IS NULL THEN 'chain' END").alias("outcome"))
    return sizes.join(found, key, "left").select(*key, F.coalesce("outcome", F.lit("broken")).alias("outcome"))


def journal_dispositions(rows: DataFrame, links: DataFrame, chains: DataFrame) -> DataFrame:
    """(target, disposition) of a whole journal table.

    rows (target, cents, is_no_post, is_memorized); links: source rows with the terminal of their chain (target, terminal);
    chains: auxiliary nodes with their context's outcome (target, outcome). A link without terminal and a broken node stay
    `unresolved`.
    """
    own = F.when(F.col("is_no_post"), "no_post").when(F.col("is_memorized"), "memorized").when(F.col("cents").isNull(), "unresolved").when(F.col("cents") == 0, "canonical_zero").otherwise("posting")
    a = rows.select("target", own.alias("disposition"))
    b = links.select("target", F.when(F.col("terminal").isNull(), "unresolved").otherwise("source").alias("disposition"))
    c = chains.select("target", F.when(F.col("outcome") == "broken", "unresolved").otherwise("source").alias("disposition"))
    return _union(a, b, c)
