"""Declared policy as joins: roles, ceilings, readable sources, decisions, limits and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

EVERYONE = ("everyone", "*")


def scoped_roles(identities: DataFrame, bindings: DataFrame, inherits: DataFrame, depth: int) -> DataFrame:
    """Distinct (persona, scope, role): bound to what the persona is or to everyone, and what roles inherit in that scope.

    identities: (persona, kind, value); bindings: (kind, value, scope, role); inherits: (role, parent). `depth`: number of roles at most.
    """
    everyone = identities.select("persona").distinct().select("persona", F.lit(EVERYONE[0]).alias("kind"), F.lit(EVERYONE[1]).alias("value"))
    found = last = identities.select("persona", "kind", "value").unionByName(everyone).join(bindings, ["kind", "value"]).select("persona", "scope", "role").distinct()
    for _ in range(depth):
        last = last.join(inherits, "role").select("persona", "scope", F.col("parent").alias("role")).distinct()
        found = found.unionByName(last)
    # Written: ceilings, grants and decisions all start from it.
    return materialize(found.distinct(), "roles")


def granted_tools(roles: DataFrame, grants: DataFrame, tools: DataFrame) -> DataFrame:
    """(persona, tool, allowed): grants (role, tool, effect) of the persona's roles; `*` is every tool; a denial wins."""
    named = grants.join(tools, "tool").select("role", "tool", "effect").unionByName(grants.where("tool = '*'").select("role", "effect").crossJoin(tools.select("tool")))
    return roles.join(named, "role").groupBy("persona", "tool").agg((F.count_if(F.col("effect") == "deny") == 0).alias("allowed"))


def argument_limits(grants: DataFrame, members: DataFrame, constraints: DataFrame) -> DataFrame:
    """(persona, tool, arg, allowed_values), the input of authorize(): what teams' constraints allow, all their values together.

    grants: (persona, tool, scope, unconstrained) of the roles that grant a tool; members: (persona, team); constraints: (team, tool,
    arg, value). A grant of the platform is limited by every team of the persona, one of a team by that team; a tool that any
    unconstrained role grants has no limits.
    """
    free_ = grants.where("unconstrained").select("persona", "tool").distinct()
    bound = grants.join(free_, ["persona", "tool"], "left_anti")
    by_platform = bound.where("scope = 'platform'").join(members, "persona").select("persona", "tool", "team")
    limiting = by_platform.unionByName(bound.where("scope <> 'platform'").select("persona", "tool", F.col("scope").alias("team"))).distinct()
    return limiting.join(constraints, ["team", "tool"]).groupBy("persona", "tool", "arg").agg(F.sort_array(F.collect_set("value")).alias("allowed_values"))


def visible_skills(skills: DataFrame, roles: DataFrame, grants: DataFrame, members: DataFrame) -> DataFrame:
    """(persona, skill, team, decision) for every persona of `roles` and every skill: visible, not granted, not a member or no access.

    skills: (skill, team or null, tags, access_roles, access_teams: arrays); roles: (persona, scope, role); grants: (role, grant), a grant
    being a name, tag:x or *; members: (persona, team). A global skill needs a grant of any role; one of a team needs membership or
    a role that grants *. Where a skill names access roles or teams, one has to fit; for a team's skill a role counts
    only in that team or on the platform.
    """
    held = roles.join(grants, "role").select("persona", "grant").distinct()
    every = roles.select("persona").distinct().crossJoin(skills)
    keys = skills.select("skill", F.explode(F.array_union(F.array(F.lit("*"), "skill"), F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("tag:"), t)))).alias("grant"))
    granted = held.join(keys, "grant").groupBy("persona", "skill").agg(F.max(F.col("grant") == "*").alias("all"))
    in_team = members.join(skills.where("team IS NOT NULL").select("skill", "team"), "team").select("persona", "skill", F.lit(True).alias("member")).distinct()
    own_roles = skills.select("skill", "team", F.explode("access_roles").alias("role")).join(roles, "role").where("team IS NULL OR scope = team OR scope = 'platform'").select("persona", "skill")
    own_teams = skills.select("skill", F.explode("access_teams").alias("team")).join(members, "team").select("persona", "skill")
    access = own_roles.unionByName(own_teams).distinct().withColumn("access", F.lit(True))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    row = every.join(granted, ["persona", "skill"], "left").join(in_team, ["persona", "skill"], "left").join(access, ["persona", "skill"], "left")
    decision = (
        F.when(F.col("team").isNull() & F.col("all").isNull(), "not granted")
        .when(F.col("team").isNotNull() & F.col("member").isNull() & ~F.coalesce("all", F.lit(False)), "not a member")
        .when((some("access_roles") | some("access_teams")) & F.col("access").isNull(), "no access")
        .otherwise("visible")
    )
    return row.select("persona", "skill", "team", decision.alias("decision"))


def document_flow(members: DataFrame, platform: DataFrame, teams: DataFrame, visible: DataFrame) -> DataFrame:
    """(persona, team, lenses, cap) of each membership: the team's lenses if it names any, else the platform's, only those visible to
    the persona, in order; the lesser of both caps.

    platform: one row (lenses, cap); teams: (team, lenses, cap), null for what a team leaves open; visible: (persona, skill).
    """
    base = platform.select(F.col("lenses").alias("base_lenses"), F.col("cap").alias("base_cap"))
    own = members.join(teams, "team", "left").crossJoin(base)
    named = own.withColumn("named", F.when(F.coalesce(F.size("lenses"), F.lit(0)) > 0, F.col("lenses")).otherwise(F.col("base_lenses")))
    each = named.select("persona", "team", F.least("cap", "base_cap").alias("cap"), F.posexplode_outer("named").alias("at", "skill"))
    seen = each.join(visible.select("persona", "skill", F.lit(True).alias("seen")).distinct(), ["persona", "skill"], "left")
    return seen.groupBy("persona", "team", "cap").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("seen"), F.struct("at", "skill")))), lambda x: x["skill"]).alias("lenses"))


def lens_plan(required: Column, chosen: Column, cap: Column) -> Column:
    """{lenses, problem}: required ones, then those chosen, each once; a problem if there are more than the cap."""
    every = F.array_distinct(F.concat(required, chosen))
    return F.struct(every.alias("lenses"), F.when(F.size(every) > cap, F.concat(F.lit("more than "), cap.cast("string"), F.lit(" lenses"))).alias("problem"))


def roles_in(roles: DataFrame, members: DataFrame) -> DataFrame:
    """(persona, team, role): roles that count in each team of a persona, held there or on the platform."""
    return roles.join(members, "persona").where("scope = 'platform' OR scope = team").select("persona", "team", "role").distinct()


def explain(tools: DataFrame, sources: DataFrame, limits: DataFrame) -> DataFrame:
    """(persona, tools, limits, readable) of each persona with tools: allowed tools, arguments with their values, readable sources.

    tools: (persona, tool, allowed); sources: (persona, source_id); limits: as of argument_limits(). Without the tool search_knowledge
    nothing is readable.
    """
    own = tools.where("allowed").groupBy("persona").agg(F.sort_array(F.collect_set("tool")).alias("tools"))
    limited = limits.groupBy("persona").agg(F.sort_array(F.collect_list(F.struct("tool", "arg", "allowed_values"))).alias("limits"))
    read = sources.groupBy("persona").agg(F.sort_array(F.collect_set("source_id")).alias("found"))
    row = own.join(limited, "persona", "left").join(read, "persona", "left")
    return row.select("persona", "tools", "limits", F.when(F.array_contains("tools", "search_knowledge"), F.coalesce("found", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("readable"))


def ceilings(roles: DataFrame, ranks: DataFrame, sources: DataFrame, default: int) -> DataFrame:
    """(persona, source_id, ceiling): the highest rank of the persona's platform roles and roles in the source's owner team."""
    own = roles.join(ranks, "role").select("persona", "scope", F.col("max_rank"))
    platform = own.where("scope = 'platform'").groupBy("persona").agg(F.max("max_rank").alias("p"))
    team = own.groupBy("persona", F.col("scope").alias("owner_team")).agg(F.max("max_rank").alias("t"))
    # Sources and personas of a policy are few; this is their matrix, the result itself.
    every = roles.select("persona").distinct().crossJoin(sources.select("source_id", "owner_team"))
    return every.join(platform, "persona", "left").join(team, ["persona", "owner_team"], "left").select("persona", "source_id", F.greatest(F.coalesce("p", F.lit(default)), F.coalesce("t", F.lit(default))).alias("ceiling"))


def source_grants(members: DataFrame, roles: DataFrame, sources: DataFrame, access: DataFrame) -> DataFrame:
    """(persona, source_id, reasons): by team, by a role in the owner team, or for everyone.

    members: (persona, team); access: (source_id, kind, value), kind being team, role or everyone.
    """
    by_team = access.where("kind = 'team'").join(members, F.col("value") == F.col("team")).select("persona", "source_id", F.concat(F.lit("team:"), "value").alias("reason"))
    by_role = access.where("kind = 'role'").join(sources.select("source_id", "owner_team"), "source_id").join(roles, (F.col("value") == F.col("role")) & (F.col("scope") == F.col("owner_team"))).select("persona", "source_id", F.concat(F.lit("role:"), "value").alias("reason"))
    all_ = members.select("persona").unionByName(roles.select("persona")).distinct()
    by_all = all_.crossJoin(access.where("kind = 'everyone'").select("source_id")).select("persona", "source_id", F.lit("everyone").alias("reason"))
    return by_team.unionByName(by_role).unionByName(by_all).groupBy("persona", "source_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def readable(grants: DataFrame, ceiling: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that are granted and whose rank is known and at most the ceiling."""
    return grants.join(ceiling, ["persona", "source_id"]).join(sources.select("source_id", "rank"), "source_id").where("rank <= ceiling").select("persona", "source_id", "ceiling")


def authorize(calls: DataFrame, tools: DataFrame, limits: DataFrame) -> DataFrame:
    """(call_id, decision) of calls (call_id, persona, tool, args map): denied, not granted, an argument's problem, or allow.

    tools: (persona, tool, allowed); limits: (persona, tool, arg, allowed_values), of which the first argument by name that fails is told.
    """
    value = F.try_element_at("args", F.col("arg"))
    problem = F.when(F.col("arg").isNull(), F.lit(None)).when(value.isNull(), F.concat(F.lit("missing "), "arg")).when(~F.array_contains("allowed_values", value), F.concat(F.lit("not allowed "), "arg"))
    problems = calls.join(limits, ["persona", "tool"]).groupBy("call_id").agg(F.min_by(problem, F.when(problem.isNotNull(), F.col("arg"))).alias("problem"))
    joined = calls.join(tools, ["persona", "tool"], "left").join(problems, "call_id", "left")
    return joined.select("call_id", F.when(F.col("allowed").isNull(), "not granted").when(~F.col("allowed"), "denied").otherwise(F.coalesce("problem", F.lit("allow"))).alias("decision"))


def rate_limits(members: DataFrame, limits: DataFrame, baseline: int) -> DataFrame:
    """(persona, tool, per_minute): the most generous team counts; `*` falls back on the baseline."""
    best = members.join(limits, "team").groupBy("persona", "tool").agg(F.max("per_minute").alias("per_minute"))
    default = members.select("persona").distinct().join(best.where("tool = '*'").select("persona"), "persona", "left_anti").select("persona", F.lit("*").alias("tool"), F.lit(baseline).alias("per_minute"))
    return best.unionByName(default)


def differences(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that came (+), went (-) or changed (~)."""
    b, a = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    mark = F.when(F.col("before").isNull(), "+").when(F.col("after").isNull(), "-").otherwise("~")
    return b.join(a, keys, "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select(*keys, mark.alias("change"), "before", "after")


def unknown_references(used: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """References (`user`, key) to what isn't there, all of them."""
    return used.join(known.select(key), key, "left_anti").groupBy(key).agg(F.sort_array(F.collect_set("user")).alias("users"))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): missing, extra or changed files of a bundle."""
    m, f = manifest.select("path", F.col("sha256").alias("want")), files.select("path", F.col("sha256").alias("have"))
    return m.join(f, "path", "full_outer").where(~F.col("want").eqNullSafe(F.col("have"))).select("path", F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").otherwise("mismatch").alias("problem"))


def match_teams(hints: DataFrame, keywords: DataFrame, members: DataFrame, most: int = 20) -> DataFrame:
    """(persona, outcome, teams): the persona's teams whose keywords stand as words in its hints; of none, its only or its default team.

    hints: (persona, n, text), of which those with n below `most` count, and 200 characters of each; keywords: (team, keyword); members:
    (persona, team, is_default). outcome: one, ambiguous, only team, default team or none. Keywords of one word are found by a join on the
    hints' words; only those of several words are searched for, in hints of members of their team.
    """
    low = hints.where(F.col("n") < most).select("persona", F.lower(F.left("text", F.lit(200))).alias("text"))
    words = keywords.where(F.length("keyword") >= 3).select("team", F.lower("keyword").alias("keyword")).distinct()
    one = F.col("keyword").rlike("^[a-z0-9]+$")
    said = low.select("persona", F.explode(F.split("text", "[^a-z0-9]+")).alias("keyword")).distinct()
    by_word = said.join(words.where(one), "keyword").select("persona", "team")
    by_phrase = low.join(members.select("persona", "team"), "persona").join(words.where(~one), "team").where(F.rlike(F.col("text"), F.concat(F.lit(r"(?<![a-z0-9])\Q"), "keyword", F.lit(r"\E(?![a-z0-9])")))).select("persona", "team")
    hit = by_word.unionByName(by_phrase).join(members.select("persona", "team"), ["persona", "team"]).groupBy("persona").agg(F.sort_array(F.collect_set("team")).alias("found"))
    own = members.groupBy("persona").agg(F.sort_array(F.collect_set("team")).alias("own"), F.min(F.when(F.col("is_default"), F.col("team"))).alias("default"))
    row = hints.select("persona").distinct().join(own, "persona", "left").join(hit, "persona", "left")
    outcome = F.when(F.size("found") == 1, "one").when(F.size("found") > 1, "ambiguous").when(F.size("own") == 1, "only team").when(F.col("default").isNotNull(), "default team").otherwise("none")
    teams = F.when(F.col("found").isNotNull(), F.col("found")).when(F.size("own") == 1, F.col("own")).when(F.col("default").isNotNull(), F.array("default")).otherwise(F.coalesce("own", F.array().cast("array<string>")))
    return row.select("persona", outcome.alias("outcome"), teams.alias("teams"))


def secret_references(sources: DataFrame) -> DataFrame:
    """(kind, name, used_by): where each secret of sources (source_id, kind, name) is used, sorted; sources without a secret name none."""
    return sources.where("kind IS NOT NULL AND name IS NOT NULL").groupBy("kind", "name").agg(F.sort_array(F.collect_set(F.concat(F.lit("sources/"), "source_id", F.lit(".yaml")))).alias("used_by"))


def mixed_scopes(platform: DataFrame, team: DataFrame) -> DataFrame:
    """(rule, role, granted_by): team memberships (rule, role) that grant a role which platform bindings (rule, role) grant as well."""
    return team.join(platform.groupBy("role").agg(F.min("rule").alias("granted_by")), "role").select("rule", "role", "granted_by").distinct()


def agent_context(asked: DataFrame, members: DataFrame, instructions: DataFrame) -> DataFrame:
    """(request_id, problem, teams, instructions) of requests (request_id, persona, team): the caller's teams and what those instruct, by team and number.

    Where a team is named, only its own instructions come; one that isn't the caller's is `unknown team`, and nothing is said.
    instructions: (team, n, text), a few for each team.
    """
    own = members.groupBy("persona").agg(F.sort_array(F.collect_set("team")).alias("teams"))
    told = members.select("persona", "team").distinct().join(instructions, "team").groupBy("persona").agg(F.sort_array(F.collect_list(F.struct("team", "n", "text"))).alias("told"))
    row = asked.join(own, "persona", "left").join(told, "persona", "left")
    none = F.array().cast("array<string>")
    wrong = F.col("team").isNotNull() & ~F.coalesce(F.array_contains("teams", F.col("team")), F.lit(False))
    said = F.transform(F.filter("told", lambda i: F.col("team").isNull() | (i["team"] == F.col("team"))), lambda i: i["text"])
    return row.select("request_id", F.when(wrong, "unknown team").alias("problem"), F.when(wrong, none).otherwise(F.coalesce("teams", none)).alias("teams"), F.when(wrong, none).otherwise(F.coalesce(said, none)).alias("instructions"))


def source_problems(sources: DataFrame, teams: DataFrame, levels: DataFrame, roles: DataFrame) -> DataFrame:
    """(file, problem): all that is wrong with definitions of sources, each problem once.

    sources: (file, source_id, owner_team, level, kind, ref, access_teams array, access_roles array), a row a file; teams: (team); levels:
    (level); roles: (role). Of files with one id the first by name counts, in the others only the name and the repetition are told; below an
    unknown level nothing more is looked at. Nulls are unknown, and a null list names nobody.
    """
    first = sources.groupBy("source_id").agg(F.min("file").alias("first"))
    flag = lambda known, c, name: known.select(F.col(c).alias(name), F.lit(True).alias(f"known_{name}")).distinct()
    row = sources.join(first, "source_id", "left").join(flag(teams, "team", "owner_team"), "owner_team", "left").join(flag(levels, "level", "level"), "level", "left")
    again = F.coalesce(F.col("first") < F.col("file"), F.lit(False))
    lost = again | F.col("known_level").isNull()
    git, ref = F.coalesce(F.col("kind") == "git", F.lit(False)), F.coalesce(F.col("ref"), F.lit("")) != ""
    named = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1).eqNullSafe(F.col("source_id"))
    told = lambda what, c: F.concat(F.lit(what), F.coalesce(F.col(c), F.lit("")))
    problems = F.array(
        F.when(~named, "the id isn't the file's name"), F.when(again, told("duplicate of ", "first")),
        F.when(~again & F.col("known_owner_team").isNull(), told("unknown owner team ", "owner_team")), F.when(~again & F.col("known_level").isNull(), told("unknown level ", "level")),
        F.when(~lost & git & ~ref, "git needs a ref"), F.when(~lost & ~git & ref, "only git has a ref"),
    )
    own = row.select("file", F.explode(F.array_compact(problems)).alias("problem"))

    def strangers(names: str, known: DataFrame, c: str) -> DataFrame:
        used = row.where(~lost).select("file", F.explode(names).alias(c)).distinct()
        return used.join(known.select(c), c, "left_anti").select("file", told(f"access of unknown {c} ", c).alias("problem"))

    return own.unionByName(strangers("access_teams", teams, "team")).unionByName(strangers("access_roles", roles, "role"))


def inheritance_cycles(inherits: DataFrame) -> DataFrame:
    """(role, members): each role that inherits itself, with all roles of its cycles, itself included. inherits: (role, parent); nulls link nothing.

    What is found reaches twice as far each time, until nothing is new, so the result doesn't depend on depth; roles of a policy are few.
    """
    edges = inherits.select("role", "parent").dropna().distinct()
    found = materialize(edges, "ancestors")
    while True:
        further = found.join(found.toDF("parent", "next"), "parent").select("role", F.col("next").alias("parent")).distinct()
        new = materialize(further.join(found, ["role", "parent"], "left_anti"), "ancestors")
        if new.isEmpty():
            break
        found = materialize(found.unionByName(new), "ancestors")
    back = found.select(F.col("parent").alias("role"), F.col("role").alias("parent"))
    return found.join(back, ["role", "parent"]).groupBy("role").agg(F.sort_array(F.collect_set("parent")).alias("members"))


def unknown_persona(asked: DataFrame, roles: DataFrame, users: DataFrame) -> DataFrame:
    """(request_id, unknown_roles, unknown_user) of ad-hoc personas (request_id, app_roles array, user): what of them the policy doesn't know.

    roles: (role); users: (user). A null or empty user is nobody, and not unknown; request_id is unique.
    """
    said = asked.select("request_id", F.explode("app_roles").alias("role")).join(roles.select("role"), "role", "left_anti")
    strange = said.groupBy("request_id").agg(F.sort_array(F.collect_set("role")).alias("strange"))
    known = users.select("user", F.lit(True).alias("known")).distinct()
    row = asked.select("request_id", "user").join(strange, "request_id", "left").join(known, "user", "left")
    return row.select("request_id", F.coalesce("strange", F.array().cast("array<string>")).alias("unknown_roles"), F.when(F.col("known").isNull() & (F.col("user") != ""), F.col("user")).alias("unknown_user"))
