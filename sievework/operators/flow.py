"""Control and data flow from node tables alone: subtree ends, enclosing scopes, definitions and uses, branches and exits.

Nodes have package_id, node_id (in pre-order: a parent before its children), parent_id (null for a root), type and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from sievework.functions.cluster import last_before, lookup, settle, unsized
from sievework.operators.graph import TERMINAL, is_statement

# Node types that open scopes, blocks and branches.
SCOPES = ["function_declaration", "arrow_function", "function_expression"]
BLOCKS = ["program", "statement_block"]
LOOPS = ["for_statement", "while_statement", "do_statement", "for_in_statement", "for_of_statement"]
#: A place beyond every node, twice which is still a long.
BEYOND = 1 << 60
#: Definitions and uses of a package of at most WHOLE nodes meet in one task, which takes some CHUNK nodes at a time; at most FEW ids of larger packages are broadcast.
WHOLE, CHUNK, FEW = 1 << 19, 1 << 17, 500_000
#: What nodes are to definitions and uses, in the tables that such a task reads; from FUNCTION on they open a scope.
IDENTIFIER, DECLARATOR, PARAMETERS, FUNCTION, DECLARATION = range(1, 6)
ROLES = {"identifier": IDENTIFIER, "variable_declarator": DECLARATOR, "formal_parameters": PARAMETERS, "arrow_function": FUNCTION, "function_expression": FUNCTION, "function_declaration": DECLARATION}


def climb(nodes: DataFrame, marked: Column) -> DataFrame:
    """package_id, node_id, end_id (the largest node below or at a node) and mark_id (its nearest ancestor, or itself, that is marked).

    Pointer doubling: in round k each node knows this for 2**k levels and points that many levels up, so a chain of 10,000 nodes
    takes 14 rounds. Nodes that point past their root are done and take part in no further lookup.
    """
    state = settle(nodes.select("package_id", "node_id", F.col("parent_id").alias("jump"), F.col("node_id").alias("end_id"), F.when(marked, F.col("node_id")).alias("mark_id")))
    while n := state.where("jump is not null").count():
        going, done = state.where("jump is not null"), state.where("jump is null")
        above = state.select("package_id", F.col("node_id").alias("jump"), F.col("jump").alias("next"), F.col("mark_id").alias("farther"))
        moved = lookup(going, above, ["package_id", "jump"], n)
        moved = moved.select("package_id", "node_id", F.col("next").alias("jump"), "end_id", F.coalesce("mark_id", "farther").alias("mark_id"))
        ends = going.groupBy("package_id", F.col("jump").alias("node_id")).agg(F.max("end_id").alias("lower_end"))
        both = moved.unionByName(done).join(ends, ["package_id", "node_id"], "left")
        state = settle(both.select("package_id", "node_id", "jump", F.greatest("end_id", "lower_end").alias("end_id"), "mark_id"))
    return state.drop("jump")


def subtree_ends(nodes: DataFrame) -> DataFrame:
    """package_id, node_id and end_id: the largest node_id in the node's subtree."""
    return climb(nodes, F.lit(False)).drop("mark_id")


def first_child(nodes: DataFrame, wanted: Column) -> DataFrame:
    """package_id, parent_id, child_id and text of the first wanted child of each node that has one."""
    first = F.min_by(F.struct("node_id", "text"), "node_id")
    return nodes.where(wanted & F.col("parent_id").isNotNull()).groupBy("package_id", "parent_id").agg(first.alias("c")).select("package_id", "parent_id", F.col("c.node_id").alias("child_id"), F.col("c.text").alias("text"))


def definitions(nodes: DataFrame) -> DataFrame:
    """package_id, name, def_id, at (where it begins to hold), node_id (whose scope it is in) and name_id.

    A declarator defines its first identifier, a function declaration too, in the scope around it; the identifiers of a function's first
    parameter list are defined in its own scope from the function on.
    """
    kinds = nodes.select("package_id", F.col("node_id").alias("parent_id"), F.col("type").alias("parent_type"), F.col("parent_id").alias("above"))
    named = kinds.where(F.col("parent_type").isin("variable_declarator", "function_declaration")).join(first_child(nodes, F.col("type") == "identifier"), ["package_id", "parent_id"])
    own = named.select("package_id", F.col("text").alias("name"), F.col("parent_id").alias("def_id"), F.col("parent_id").alias("at"), F.col("above").alias("node_id"), F.col("child_id").alias("name_id"))
    lists = first_child(nodes, F.col("type") == "formal_parameters").join(kinds.where(F.col("parent_type").isin(SCOPES)), ["package_id", "parent_id"])
    lists = lists.select("package_id", F.col("parent_id").alias("function"), F.col("child_id").alias("parent_id"))
    given = nodes.where("type = 'identifier'").join(lists, ["package_id", "parent_id"])
    return own.unionByName(given.select("package_id", F.col("text").alias("name"), F.col("node_id").alias("def_id"), F.col("function").alias("at"), F.col("function").alias("node_id"), F.col("node_id").alias("name_id")))


def def_use_scopes(nodes: DataFrame) -> DataFrame:
    """package_id, src (a definition) and dst (a use): the latest definition before a use in the innermost scope around it that has one.

    What a name means changes only where it is defined and where a scope that defines it ends; there it means again what it meant right before
    that scope. So each (scope, name) adds one end, which points to the change before the scope's start, and pointers are doubled until they
    are at a definition or at nothing. Uses and pointers both look for the last change before a place. Nothing is a product of definitions and uses.
    Packages of at most WHOLE nodes are shuffled once and resolved where they are; those with more are spread over tasks and take a round of tables for each doubling.
    """
    nodes = nodes.where("package_id is not null and node_id is not null")
    large = settle(nodes.groupBy("package_id").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select("package_id"))
    if not (n := large.count()):
        return def_use_whole(nodes)
    large = F.broadcast(large) if n <= FEW else large
    return def_use_whole(nodes.join(large, "package_id", "left_anti")).unionByName(def_use_spread(nodes.join(large, "package_id", "left_semi")))


def def_use_whole(nodes: DataFrame) -> DataFrame:
    """def_use_scopes() of packages that each fit in a task. A parent that isn't there counts as none; of nodes with one id one counts."""
    role = reduce(lambda other, x: F.when(F.col("type") == x[0], x[1]).otherwise(other), ROLES.items(), F.lit(0)).cast("byte")
    rows = nodes.select("package_id", F.col("node_id").cast("long"), F.col("parent_id").cast("long"), role.alias("role"), F.when(F.col("type") == "identifier", F.col("text")).alias("name"))
    package = S.StructField("package_id", rows.schema["package_id"].dataType)
    schema = S.StructType([package, S.StructField("src", S.LongType()), S.StructField("dst", S.LongType())])
    return rows.repartition("package_id").sortWithinPartitions(*rows.columns).mapInArrow(resolved, schema)


def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src and dst of rows that are sorted by package and node, some CHUNK rows at a time; a package's rows stay together."""
    held, size = [], 0
    for b in chain(batches, [None]):
        if b is not None:
            held, size = [*held, b], size + b.num_rows
        if not size or (b is not None and size < CHUNK):
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        package = rows["package_id"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        end = size if b is None else int(np.searchsorted(package, package[-1]))  # the last package may go on
        held, size = rows.slice(end).to_batches(), size - end
        if not end:
            continue
        rows, package = rows.slice(0, end), package[:end]
        node, role = rows["node_id"].to_numpy(), rows["role"].to_numpy()
        up = parents(package, node, pc.fill_null(rows["parent_id"], 0).to_numpy(), rows["parent_id"].is_valid().to_numpy())
        name = pc.fill_null(rows["name"].combine_chunks().dictionary_encode().indices, -1).to_numpy().astype(np.int64)
        src, dst = def_use_rows(package, up, role, name)
        yield pa.RecordBatch.from_arrays([rows["package_id"].combine_chunks().take(pa.array(dst)), pa.array(node[src]), pa.array(node[dst])], names=["package_id", "src", "dst"])


def parents(package: np.ndarray, node: np.ndarray, parent: np.ndarray, has: np.ndarray) -> np.ndarray:
    """The row of each row's parent in the same package, or -1; -2 for a row whose node has been before."""
    ids, rank = np.unique(np.concatenate([node, parent]), return_inverse=True)
    own, above = (package * len(ids) + r for r in np.split(rank, 2))
    at = np.minimum(np.searchsorted(own, above), len(own) - 1)
    return np.where(np.append(False, own[1:] == own[:-1]), -2, np.where(has & (own[at] == above), at, -1))


def doubled(jump: np.ndarray, rows: np.ndarray, take: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Follows pointers (-1: none) from rows, doubling them in each round: take(i, j) has rows i and j, where they point to, share what they know. Ends on cycles too."""
    for _ in range(len(jump).bit_length() + 1):
        i = rows[jump[rows] >= 0]
        if not len(i):
            return
        far = jump[jump[i]]
        take(i, jump[i])
        jump[i] = far


def def_use_rows(package: np.ndarray, up: np.ndarray, role: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of definitions and of the uses that mean them, from the rows of parents, roles and numbers of names (-1: none) in rows that are sorted by package and node."""
    n, every = len(up), np.arange(len(up))
    alone, role = up > -2, np.where(up > -2, role, 0)
    is_scope = role >= FUNCTION
    mark, jump = np.where(is_scope, every, -1), np.where(is_scope, -1, np.maximum(up, -1))  # the nearest scope above or at a node

    def find(i: np.ndarray, j: np.ndarray) -> None:
        mark[i] = mark[j]

    doubled(jump, every, find)
    scopes = np.flatnonzero(is_scope)
    last, within = every.copy(), alone & (mark >= 0)
    np.maximum.at(last, mark[within], every[within])
    outer = np.full(n, -1)
    outer[scopes] = np.where(up[scopes] >= 0, mark[up[scopes]], -1)

    def widen(i: np.ndarray, j: np.ndarray) -> None:
        np.maximum.at(last, j, last[i])

    doubled(outer, scopes, widen)

    named = np.flatnonzero((role == IDENTIFIER) & (up >= 0))
    owner, first = np.unique(up[named], return_index=True)
    own = (role[owner] == DECLARATOR) | (role[owner] == DECLARATION)
    declared, name_at = owner[own], named[first[own]]
    low = np.where(up[declared] >= 0, mark[up[declared]], -1)
    lists = np.flatnonzero((role == PARAMETERS) & (up >= 0))
    lists = lists[np.unique(up[lists], return_index=True)[1]]
    listed = named[role[up[named]] == PARAMETERS]
    given = listed[np.isin(up[listed], lists[is_scope[up[lists]]])]
    into = up[up[given]]
    used = (role == IDENTIFIER) & (name >= 0)
    used[name_at] = used[listed] = False
    uses = np.flatnonzero(used)

    # Places are doubled: a parameter holds from right after its function's node, a scope ends right after its last one.
    defs, names, low, start = (np.concatenate(x) for x in ((declared, given), (name[name_at], name[given]), (low, into), (declared * 2, into * 2 + 1)))
    defs, names, low, start = (x[names >= 0] for x in (defs, names, low, start))
    width = int(name.max(initial=0)) + 1
    closed, of = np.divmod(np.unique(low[low >= 0] * width + names[low >= 0]), width)
    d, c, beyond = len(defs), len(closed), 4 * n
    group = np.concatenate([package[defs] * width + names, *[package[closed] * width + of] * 2, package[uses] * width + name[uses]])
    at = np.concatenate([start, last[closed] * 2 + 1, closed * 2, uses * 2])
    tie = np.concatenate([defs, beyond - closed, np.full(c + len(uses), beyond)])
    change = np.concatenate([np.arange(d + c), np.full(c + len(uses), -1)])
    order = np.lexsort((tie, at, group))
    before = np.maximum.accumulate(np.append(-1, np.where(change[order] >= 0, np.arange(len(order)), -1))[:-1])
    begins = np.maximum.accumulate(np.where(np.append(True, group[order][1:] != group[order][:-1])[: len(order)], np.arange(len(order)), 0))
    seen = np.empty(len(order), dtype=np.int64)
    seen[order] = np.where(before >= begins, change[order][before], -1)

    # What each end means: a definition (its number), nothing (-1), or what the end that it points to means.
    probe, use = seen[d + c : d + 2 * c], seen[d + 2 * c :]
    means = np.where(probe < d, probe, -1)

    def settle_end(i: np.ndarray, j: np.ndarray) -> None:
        means[i] = means[j]

    doubled(np.where(probe >= d, probe - d, -1), np.arange(c), settle_end)
    found = np.append(np.arange(d), means)[use] if d + c else use
    kept = (use >= 0) & (found >= 0)
    return defs[found[kept]], uses[kept]


def def_use_spread(nodes: DataFrame) -> DataFrame:
    """def_use_scopes() of packages of any size: a name's rows are spread over many tasks (last_before)."""
    is_scope = F.col("type").isin(SCOPES)
    reach = unsized(climb(nodes, is_scope))
    defs = definitions(nodes)
    scope = lookup(defs.where("node_id is not null"), reach.select("package_id", "node_id", F.col("mark_id").alias("low")), ["package_id", "node_id"], nodes.count())
    scope = scope.unionByName(defs.where("node_id is null").withColumn("low", F.lit(None).cast("long")))
    high = reach.select("package_id", F.col("node_id").alias("low"), F.col("end_id").alias("high"))
    inner = scope.where("low is not null").join(high, ["package_id", "low"])
    # Places are doubled: a parameter holds from right after its function's node, a scope ends right after its last one.
    start = F.col("at") * 2 + F.when(F.col("at") == F.col("low"), 1).otherwise(0)
    event = lambda kind, at, tie, **more: [F.lit(kind).alias("kind"), at.alias("at"), tie.alias("tie"), *[c.alias(k) for k, c in more.items()]]
    none = F.lit(None).cast("long")
    begins = scope.select("package_id", "name", *event("def", F.when(F.col("low").isNotNull(), start).otherwise(F.col("at") * 2), F.col("def_id"), id=F.col("def_id"), low=none))
    closed = inner.select("package_id", "name", "low", "high").distinct()
    ends = closed.select("package_id", "name", *event("end", F.col("high") * 2 + 1, F.lit(BEYOND) - F.col("low"), id=none, low=F.col("low")))
    probes = closed.select("package_id", "name", *event("probe", F.col("low") * 2, F.lit(BEYOND), id=none, low=F.col("low")))
    not_uses = defs.select("package_id", F.col("name_id").alias("node_id")).unionByName(listed_parameters(nodes)).distinct()
    used = nodes.where("type = 'identifier'").join(not_uses, ["package_id", "node_id"], "left_anti")
    uses = used.select("package_id", F.col("text").alias("name"), *event("use", F.col("node_id") * 2, F.lit(BEYOND), id=F.col("node_id"), low=none))
    change = F.when(F.col("kind").isin("def", "end"), F.struct("kind", "id", "low"))
    seen = settle(last_before(begins.unionByName(ends).unionByName(probes).unionByName(uses), ["package_id", "name"], "at", ["tie", "kind"], change, "change"))

    # What each end means: a definition, nothing, or what the end of scope `jump` means.
    key = ["package_id", "name", "low"]
    at_end = F.col("change.kind") == "end"
    state = unsized(settle(seen.where("kind = 'probe'").select(*key, F.when(at_end, F.col("change.low")).alias("jump"), F.when(~at_end, F.col("change.id")).alias("def_id"))))
    while n := state.where("jump is not null").count():
        farther = state.select("package_id", "name", F.col("low").alias("jump"), F.col("jump").alias("next"), F.col("def_id").alias("found"))
        moved = lookup(state.where("jump is not null").drop("def_id"), farther, ["package_id", "name", "jump"], n)
        state = unsized(settle(state.where("jump is null").unionByName(moved.select(*key, F.col("next").alias("jump"), F.col("found").alias("def_id")))))

    wanted = seen.where("kind = 'use' and change is not null").select("package_id", "name", F.col("id").alias("dst"), F.col("change.id").alias("src"), F.col("change.low").alias("low"))
    after = wanted.where("low is not null").drop("src")
    resolved = lookup(after, state.where("def_id is not null").select(*key, F.col("def_id").alias("src")), key, max(after.count(), 1))
    return wanted.where("low is null").select("package_id", "src", "dst").unionByName(resolved.select("package_id", "src", "dst"))


def listed_parameters(nodes: DataFrame) -> DataFrame:
    """package_id and node_id of the identifiers in any parameter list: they are no uses."""
    lists = nodes.where("type = 'formal_parameters'").select("package_id", F.col("node_id").alias("parent_id"))
    return nodes.where("type = 'identifier'").join(lists, ["package_id", "parent_id"]).select("package_id", "node_id")


def block_statements(nodes: DataFrame) -> DataFrame:
    """package_id, block, node_id, type and next_id (the block's next statement) of each statement in a block."""
    blocks = nodes.where(F.col("type").isin(BLOCKS)).select("package_id", F.col("node_id").alias("block"))
    rows = nodes.where(is_statement(F.col("type"))).withColumnRenamed("parent_id", "block").where("block is not null")
    inside = lookup(rows, blocks, ["package_id", "block"], nodes.count()).select("package_id", "block", "node_id", "type", (-F.col("node_id")).alias("back"))
    return last_before(inside, ["package_id", "block"], "back", [], F.col("node_id"), "next_id").drop("back")


def bodies(nodes: DataFrame, openers: DataFrame) -> DataFrame:
    """package_id, opener, part (then, else, loop, try or catch) and body of the branching statements of openers (package_id, opener, opener_type).

    A body is a block or a bare statement. An if's first one before any `else` is its consequent; its alternate is the first in its last else clause that has
    one, or else its first after the `else`. A loop's is its first block, or else its last statement; a try's and its last catch clause's are their first blocks.
    """
    kind, node = F.col("type"), F.col("node_id")
    block = kind == "statement_block"
    either = block | is_statement(kind)
    n = nodes.count()
    children = settle(lookup(nodes.where("parent_id is not null").withColumnRenamed("parent_id", "opener"), openers, ["package_id", "opener"], n))
    each = children.groupBy("package_id", "opener").agg(
        F.first("opener_type").alias("opener_type"), F.min(F.when(either, node)).alias("first"), F.min(F.when(block, node)).alias("first_block"), F.max(F.when(is_statement(kind), node)).alias("last_statement"),
        F.min(F.when(kind == "else", node)).alias("else_at"), F.max(F.when(kind == "catch_clause", node)).alias("catch"),
    )
    inside = lambda what: nodes.where(what & F.col("parent_id").isNotNull()).groupBy("package_id", F.col("parent_id").alias("clause")).agg(F.min("node_id").alias("body"))
    clauses = children.where("type = 'else_clause' and opener_type = 'if_statement'").select("package_id", "opener", F.col("node_id").alias("clause"))
    in_clause = clauses.join(inside(either), ["package_id", "clause"]).groupBy("package_id", "opener").agg(F.max_by("body", "clause").alias("alternate"))
    after = children.where(either).join(each.where("else_at is not null").select("package_id", "opener", "else_at"), ["package_id", "opener"])
    after = after.where("node_id > else_at").groupBy("package_id", "opener").agg(F.min("node_id").alias("later"))
    rows = each.join(in_clause, ["package_id", "opener"], "left").join(after, ["package_id", "opener"], "left")
    caught = rows.where("opener_type = 'try_statement'").select("package_id", "opener", F.col("catch").alias("clause")).join(inside(block), ["package_id", "clause"])
    is_if, is_loop, is_try = F.col("opener_type") == "if_statement", F.col("opener_type").isin(LOOPS), F.col("opener_type") == "try_statement"
    part = lambda name, where, body: F.when(where, F.struct(F.lit(name).alias("part"), body.alias("body")))
    parts = F.array(
        part("then", is_if, F.when(F.col("else_at").isNull() | (F.col("first") < F.col("else_at")), F.col("first"))), part("else", is_if, F.coalesce("alternate", "later")),
        part("loop", is_loop, F.coalesce("first_block", "last_statement")), part("try", is_try, F.col("first_block")),
    )
    out = rows.select("package_id", "opener", F.explode(F.array_compact(parts)).alias("p")).select("package_id", "opener", "p.part", "p.body").where("body is not null")
    return out.unionByName(caught.select("package_id", "opener", F.lit("catch").alias("part"), "body"))


def cfg_edges(nodes: DataFrame) -> DataFrame:
    """package_id, src, dst and edge_type (cfg_next or cfg_branch), repeated ones kept.

    Statements of a block follow each other; return, throw, break and continue lead nowhere. An if branches to its bodies, and past itself if
    it has no alternate; a loop to its body and past itself, and its body's last statement back to it; each statement of a try to the first of its
    catch. Last statements of an if's, a try's and a catch's bodies go on after it, if the block has a next statement.
    """
    statements = settle(block_statements(nodes))
    branching = F.col("type").isin("if_statement", "try_statement", *LOOPS)
    openers = statements.where(branching).select("package_id", F.col("node_id").alias("opener"), F.col("type").alias("opener_type"), F.col("next_id").alias("after"))
    found = bodies(nodes, openers.drop("after"))
    bounds = statements.groupBy("package_id", F.col("block").alias("body")).agg(F.min("node_id").alias("first"), F.max(F.struct("node_id", "type")).alias("last"))
    bare = nodes.where(is_statement(F.col("type"))).select("package_id", F.col("node_id").alias("body"), F.col("node_id").alias("first"), F.struct("node_id", "type").alias("last"))
    ends = settle(found.join(bounds.unionByName(bare), ["package_id", "body"]).join(openers, ["package_id", "opener"]))
    goes_on = ~F.col("last.type").isin(TERMINAL)
    edge = lambda src, dst, kind: [src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type")]
    part, opener, after, last, first = (F.col(c) for c in ("part", "opener", "after", "last.node_id", "first"))
    loop = F.col("opener_type").isin(LOOPS)
    no_else = openers.where("opener_type = 'if_statement'").join(found.where("part = 'else'").select("package_id", "opener"), ["package_id", "opener"], "left_anti")
    tried = ends.where("part = 'try'").select("package_id", "opener", F.col("body").alias("block"))
    caught = tried.join(ends.where("part = 'catch'").select("package_id", "opener", "first"), ["package_id", "opener"])
    kinds = [
        statements.where(~branching & ~F.col("type").isin(TERMINAL)).select("package_id", *edge(F.col("node_id"), F.col("next_id"), "cfg_next")),
        ends.where(part.isin("then", "else", "loop")).select("package_id", *edge(opener, first, "cfg_branch")),
        ends.where(part.isin("then", "else", "try", "catch") & goes_on).select("package_id", *edge(last, after, "cfg_next")),
        ends.where((part == "loop") & goes_on).select("package_id", *edge(last, opener, "cfg_branch")),
        no_else.unionByName(openers.where(loop)).select("package_id", *edge(opener, after, "cfg_branch")),
        lookup(statements, caught, ["package_id", "block"], nodes.count()).select("package_id", *edge(F.col("node_id"), first, "cfg_branch")),
    ]
    return reduce(DataFrame.unionByName, kinds).where("dst is not null")


def exits(nodes: DataFrame) -> DataFrame:
    """package_id, node_id and exit_id: where control goes after each statement of a block that isn't terminal, up through the statements around it.

    That is the block's next statement; at a block's end the loop that it is the body of, or what comes after the if or try that it belongs to.
    A function's or the program's end has no exit. Pointers to the statement around are doubled, so deep nesting takes few rounds.
    """
    statements = settle(block_statements(nodes))
    branching = F.col("type").isin("if_statement", "try_statement", *LOOPS)
    openers = statements.where(branching).select("package_id", F.col("node_id").alias("opener"), F.col("type").alias("opener_type"))
    owner = bodies(nodes, openers).join(openers, ["package_id", "opener"]).select("package_id", F.col("body").alias("block"), "opener", F.col("opener_type").isin(LOOPS).alias("loop"))
    last = lookup(statements.where("next_id is null"), owner, ["package_id", "block"], nodes.count())
    known = statements.where("next_id is not null").select("package_id", "node_id", "type", F.col("next_id").alias("exit_id"), F.lit(None).cast("long").alias("jump"))
    state = known.unionByName(last.select("package_id", "node_id", "type", F.when(F.col("loop"), F.col("opener")).alias("exit_id"), F.when(~F.col("loop"), F.col("opener")).alias("jump")))
    state = settle(state)
    while n := state.where("jump is not null").count():
        farther = state.select("package_id", F.col("node_id").alias("jump"), F.col("jump").alias("next"), F.col("exit_id").alias("found"))
        going = state.where("jump is not null").drop("exit_id")
        moved = lookup(going, farther, ["package_id", "jump"], n)
        state = settle(state.where("jump is null").unionByName(moved.select("package_id", "node_id", "type", F.col("found").alias("exit_id"), F.col("next").alias("jump"))))
    return state.where(F.col("exit_id").isNotNull() & ~F.col("type").isin(TERMINAL)).select("package_id", "node_id", "exit_id")
