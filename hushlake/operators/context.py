"""Page context: what kind of page an address and its elements belong to, and the policy for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions import dims
from hushlake.functions.text import host_suffixes, once, url_host, url_ok, url_path, url_query
from hushlake.operators.containment import contained
from hushlake.sources.scratch import stored

#: Pairs of a host and its signature that are copied to all tasks; more of them join by key.
FEW_SIGNATURES = 10_000


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``ok``, ``host``, ``path`` and ``query`` of an address; a malformed one is all path."""
    u = F.col(url)
    return (
        df.withColumn("ok", url_ok(u))
        .withColumn("host", F.when(F.col("ok"), url_host(u)).otherwise(F.lit("")))
        .withColumn("path", F.lower(F.when(F.col("ok"), url_path(u)).otherwise(F.coalesce(u, F.lit("")))))
        .withColumn("query", F.when(F.col("ok"), url_query(u)).otherwise(F.lit("")))
    )


def host_hits(pages: DataFrame, signatures: DataFrame, small: bool = False) -> DataFrame:
    """Rows of ``pages`` (with host and path) with every signature of their host: context, app, domain, ord.

    A host is expanded to its parent domains and equi-joined with the signature domains.  ``small`` says that the
    signatures are the built-in ones, whose number is fixed.  Of others, domains that hold a character no host has (they
    stand for parts of addresses) are left out first; distinct hosts meet the rest, and rows meet what fits their host.
    """
    names = ["context", "app", "domain", "path_rule", "ord"]
    if small:
        hits = _by_domain(pages, F.broadcast(signatures.select(*names)))
    else:
        possible = signatures.select(*names).filter(~F.col("domain").rlike("[/?#:]"))
        fit = stored(_by_domain(pages.select("host").distinct(), possible.hint("merge")))  # counted and joined
        hits = pages.join(F.broadcast(fit) if fit.count() <= FEW_SIGNATURES else fit.hint("merge"), "host")
    hits = hits.filter(F.col("path_rule").isNull() | F.call_function("rlike", F.col("path"), F.col("path_rule")))
    return hits.select(*pages.columns, "context", "app", "domain", "ord")


def _by_domain(hosts: DataFrame, signatures: DataFrame) -> DataFrame:
    return hosts.withColumn("domain", F.explode(host_suffixes(F.col("host")))).join(signatures, "domain")


def match_signatures(pages: DataFrame, signatures: DataFrame, small: bool = False) -> DataFrame:
    """First signature of each context for every (host, path) of ``pages``, with its place ``ord``.

    Works on the distinct (host, path) pairs.  Returns host, path, context, app, domain, ord; ``small`` as in ``host_hits``.
    """
    hits = host_hits(pages.select("host", "path").distinct(), signatures, small)
    first = hits.groupBy("host", "path", "context").agg(F.min_by(F.struct("app", "domain", "ord"), F.col("ord")).alias("s"))
    return first.select("host", "path", "context", F.col("s.app").alias("app"), F.col("s.domain").alias("domain"), F.col("s.ord").alias("ord"))


def anywhere_hits(pages: DataFrame, signatures: DataFrame, url: str = "url", context: str = "AI_ASSISTANT") -> DataFrame:
    """Rows of ``pages`` (with path) with every signature of one context whose domain stands anywhere in their address.

    For any number of signatures: addresses meet the domains they hold through an index on the domains' rarest pieces.
    """
    wanted = signatures.filter(F.col("context") == context).withColumn("__domain", F.lower("domain"))
    seen = pages.withColumn("__low", F.lower(url))
    held = contained(seen.select("__low"), wanted.select("__domain"), [], "__low", "__domain")
    hits = seen.join(held.hint("merge"), "__low").join(wanted.hint("merge"), "__domain").filter(
        F.col("path_rule").isNull() | F.call_function("rlike", F.col("path"), F.col("path_rule"))
    )
    return hits.select(*pages.columns, "context", "app", "domain", "ord")


def match_anywhere(pages: DataFrame, signatures: DataFrame, url: str = "url", context: str = "AI_ASSISTANT") -> DataFrame:
    """``anywhere_hits`` of the distinct addresses: url, path, context, app, domain, ord."""
    return anywhere_hits(pages.select(url, "path").distinct(), signatures, url, context)


def register_signatures(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Signatures with user-supplied ones behind the built-in ones."""
    return base.unionByName(extra.withColumn("ord", (F.col("ord") + 1_000_000).cast("int")))


def _first_rule(subject: list[Column], rules: list[tuple[str, str, int]]) -> tuple[Column, Column]:
    label = score = None
    for pattern, name, points in rules:
        cond = subject[0].rlike(pattern)
        for s in subject[1:]:
            cond = cond | s.rlike(pattern)
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
        score = F.when(cond, F.lit(points)) if score is None else score.when(cond, F.lit(points))
    return label, score.otherwise(F.lit(0))


def auth_url_signals(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``auth_host``, ``auth_path``, ``auth_query`` signals and their summed ``auth_url_score``."""
    host_label, host_score = _first_rule([F.col("host")], dims.AUTH_HOST_RULES)
    path_label, path_score = _first_rule([F.col("path"), F.lower(F.col(url))], dims.AUTH_PATH_RULES)
    out = df.withColumn("auth_host", host_label).withColumn("auth_path", path_label)
    query = (
        F.col("ok")
        & F.col("query").rlike(dims.AUTH_QUERY_RULE)
        & ~F.coalesce(F.col("auth_path").startswith("URL_AUTH"), F.lit(False))
    )
    return out.withColumn("auth_query", F.when(query, F.lit("URL_AUTH_QUERY"))).withColumn(
        "auth_url_score", (host_score + path_score + F.when(query, 30).otherwise(0)).cast("int")
    )


# Signals of the page elements.  A page without elements has none of them.
DOM_FLAGS = [
    "password_inputs", "user_input", "otp_input", "auth_button", "auth_heading", "auth_form",
    "composer", "thread", "send_button", "editable",
    "feed", "post", "interaction", "ai_composer", "ai_send",
]


def with_context(df: DataFrame, signatures: DataFrame, url: str = "url", strict: bool = False, small: bool = False) -> DataFrame:
    """Adds the four scores, ``context``, ``confidence`` and ``app``.

    ``df`` may carry ``signals`` (the struct of element signals); without it only the address
    counts.  ``strict`` accepts an assistant site by its host only, otherwise its domain may
    stand anywhere in the address.
    """
    pages = auth_url_signals(with_url_parts(df, url), url)
    if "signals" not in df.columns:
        pages = pages.withColumn("signals", F.lit(None).cast(SIGNALS))
    s = {f: F.coalesce(F.col(f"signals.{f}"), F.lit(0)) for f in DOM_FLAGS if f != "auth_button"}
    button = F.coalesce(F.col("signals.auth_button"), F.lit(""))

    sig = match_signatures(pages, signatures, small)
    wide = sig.groupBy("host", "path").agg(
        *[
            F.min(F.when(F.col("context") == c, F.col(col))).alias(f"{c.lower()}_{col}")
            for c in ("MESSAGING", "SOCIAL_MEDIA", "AI_ASSISTANT")
            for col in ("app", "domain")
        ]
    )
    out = pages.join(wide, ["host", "path"], "left")

    # Authentication.
    auth_score = (
        F.col("auth_url_score")
        + F.when(s["password_inputs"] >= 1, 25).otherwise(0)
        + F.when(s["password_inputs"] >= 2, 25).otherwise(0)
        + F.when(s["user_input"] > 0, 20).otherwise(0)
        + F.when(s["otp_input"] > 0, 45).otherwise(0)
        + F.when(button.isin("login", "signup"), 30).when(button == "reset", 35).otherwise(0)
        + F.when(s["auth_heading"] > 0, 25).otherwise(0)
        + F.when(s["auth_form"] > 0, 20).otherwise(0)
    )
    has_url = F.col("auth_path").isNotNull() | F.col("auth_query").isNotNull()
    has_host = F.col("auth_host").isNotNull()
    password, several = s["password_inputs"] >= 1, s["password_inputs"] >= 2
    otp, heading = s["otp_input"] > 0, s["auth_heading"] > 0
    strong = (
        (password & (s["user_input"] > 0) & button.isin("login", "signup"))
        | (has_url & password)
        | (otp & (has_url | heading | (button == "reset")))
        | (several & (button.isin("signup", "reset") | heading))
        | F.coalesce(
            F.col("auth_path").isin(
                "URL_AUTH_LOGIN", "URL_AUTH_SIGNUP", "URL_PASSWORD_RESET", "URL_ACCOUNT_RECOVERY", "URL_MFA_OTP"
            ),
            F.lit(False),
        )
        | has_host
    )
    credible = password | otp | has_url | has_host | (heading & (button != ""))
    out = out.withColumn("auth_score", once(auth_score.cast("int"))).withColumn("__strong", credible & strong)
    out = out.withColumn("__credible", credible)
    auth_score = F.col("auth_score")
    is_auth = F.col("__strong") | (F.col("__credible") & (auth_score >= 55))

    # Messaging.
    known_ai = F.col("ai_assistant_app").isNotNull()
    known_msg = F.col("messaging_app").isNotNull()
    msg_path = F.col("path").rlike(dims.MESSAGING_PATH_RULE)
    composer, thread = s["composer"] > 0, s["thread"] > 0
    send = (s["send_button"] > 0) & (composer | thread | known_msg)
    msg_score = (
        F.when(known_msg, 90).otherwise(0)
        + F.when(msg_path, 25).otherwise(0)
        + F.when(composer, 35).otherwise(0)
        + F.when(thread, 30).otherwise(0)
        + F.when(send, 20).otherwise(0)
        + F.when((s["editable"] > 0) & ~composer & ~thread & ~known_msg, 5).otherwise(0)
    )
    msg_score = F.when(known_ai, 0).otherwise(msg_score)
    combo = (msg_path & (composer | thread)) | (composer & thread) | (composer & send)
    is_msg = ~known_ai & ((msg_score >= 60) | combo)

    # Social media.
    known_soc = F.col("social_media_app").isNotNull()
    soc_score = (
        F.when(known_soc, 95).otherwise(0)
        + F.when(s["feed"] > 0, 35).otherwise(0)
        + F.when(s["post"] > 0, 35).otherwise(0)
        + F.when(s["interaction"] > 0, 20).otherwise(0)
        + F.when(F.col("path").rlike(dims.SOCIAL_PATH_RULE), 20).otherwise(0)
    )

    # Assistants.
    ai_app, ai_known = F.col("ai_assistant_app"), known_ai
    if not strict:
        anywhere = None
        for context, app, domains, _ in dims.SIGNATURES:
            if context == "AI_ASSISTANT":
                cond = None
                for d in domains:
                    c = F.lower(F.col(url)).contains(d)
                    cond = c if cond is None else cond | c
                anywhere = F.when(cond, F.lit(app)) if anywhere is None else anywhere.when(cond, F.lit(app))
        ai_app = F.coalesce(anywhere, ai_app)
        ai_known = ai_app.isNotNull()
    ai_score = (
        F.when(ai_known, 85).otherwise(0)
        + F.when(s["ai_composer"] > 0, 35).otherwise(0)
        + F.when(s["ai_send"] > 0, 30).otherwise(0)
    )

    out = (
        out.withColumn("messaging_score", once(msg_score.cast("int"))).withColumn("social_score", soc_score.cast("int"))
        .withColumn("assistant_score", ai_score.cast("int")).withColumn("__msg", is_msg).withColumn("__ai", ai_app)
        .withColumn("__auth", is_auth)
    )
    msg_score, soc_score, ai_score = F.col("messaging_score"), F.col("social_score"), F.col("assistant_score")
    is_auth, is_msg, is_soc, is_ai, ai_app = F.col("__auth"), F.col("__msg"), soc_score >= 60, ai_score >= 60, F.col("__ai")

    def confidence(score: Column, floor: float) -> Column:
        return F.least(F.lit(0.99), F.greatest(F.lit(floor), score / 100))

    context = (
        F.when(is_auth, "AUTHENTICATION").when(is_msg, "MESSAGING").when(is_soc, "SOCIAL_MEDIA")
        .when(is_ai, "AI_ASSISTANT").when(F.col("ok"), "NORMAL").otherwise("UNKNOWN")
    )
    conf = (
        F.when(is_auth, confidence(auth_score, 0.70)).when(is_msg, confidence(msg_score, 0.75))
        .when(is_soc, confidence(soc_score, 0.85)).when(is_ai, confidence(ai_score, 0.75))
        .when(F.col("ok"), F.lit(0.95)).otherwise(F.lit(0.5))
    )
    app = F.when(is_auth, F.lit(None)).when(is_msg, F.col("messaging_app")).when(is_soc, F.col("social_media_app")).when(is_ai, ai_app)
    return out.select(
        *df.columns,
        "auth_score", "messaging_score", "social_score", "assistant_score",
        context.alias("context"), conf.alias("confidence"), app.alias("app"),
    )


SIGNALS = "struct<" + ",".join(f"{f}:{'string' if f == 'auth_button' else 'int'}" for f in DOM_FLAGS) + ">"


def with_policy(df: DataFrame, policies: DataFrame) -> DataFrame:
    """Policy row of each context (six rows, broadcast) and ``agent_blocked``."""
    out = df.join(F.broadcast(policies), "context", "left")
    return out.withColumn(
        "agent_blocked", (F.col("policy") == "BLOCK_ALL") | ~F.coalesce(F.col("allow_actions"), F.lit(False))
    )


# Phrases that introduce a search, tried in order, and phrases without content.
SEARCH_RULES = [
    r"(?:find\s+(?:the\s+)?search\s+(?:box|bar|input)\s+and\s+)?search\s+(?:for\s+)?[\"']?([^\"'\.\n,]+)[\"']?",
    r"(?:look\s+up|query)\s+(?:for\s+)?[\"']?([^\"'\.\n,]+)[\"']?",
    r"search\s+[\"']?([^\"'\.\n,]+)[\"']?",
]
SEARCH_GENERIC = ["a specified query", "specified query", "query", "something"]
SEARCH_DEFAULT = "internships"


def search_intent(text: Column) -> Column:
    """What a task text asks to search for; a default when it names nothing."""
    from hushlake.functions.catalog import java
    from hushlake.functions.text import trim_spaces

    expr = None
    for pattern in SEARCH_RULES:
        raw = F.regexp_extract(text, java(pattern, True), 1)
        phrase = trim_spaces(F.regexp_replace(trim_spaces(raw), "^[\"']+|[\"']+\\z", ""))
        value = F.when(F.lower(phrase).isin(SEARCH_GENERIC), F.lit(SEARCH_DEFAULT)).otherwise(phrase)
        expr = F.when(phrase != "", value) if expr is None else expr.when(phrase != "", value)
    return expr.otherwise(F.lit(SEARCH_DEFAULT))
