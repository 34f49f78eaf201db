"""Rules over configuration: Dockerfiles, compose files, workflow files, Kubernetes manifests, Terraform."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import forward_slashes
from codequarry.sources.files import delivered_lines

# Severity and confidence of each rule, patterns, ports, event paths.
RULES = {
    "IAC001": ("medium", 70), "IAC003": ("high", 80), "IAC004": ("high", 75), "IAC005": ("medium", 70), "IAC006": ("high", 75), "IAC007": ("medium", 95),
    "IAC009": ("medium", 90), "IAC010": ("high", 95), "IAC011": ("high", 95), "IAC012": ("high", 90), "IAC013": ("high", 80), "IAC014": ("medium", 60),
    "IAC015": ("high", 80),
}
IMAGE_SECRET = (
    r"(?i)^(?:ENV|ARG)\s+(?:[A-Za-z_]\w*=\S+\s+)*([A-Za-z_]\w*)\s*=\s*(?:'([^'\"\s]{8,})'|\"([^'\"\s]{8,})\"|([^'\"\s]{8,}))"
)
SECRET_NAME = r"(?i)API_KEY|SECRET|PASSWORD|PASSWD|TOKEN|AUTH|PRIVATE_KEY|ACCESS_KEY|DB_PASS|DATABASE_URL"
COMPOSE_SECRET = r"(?i)(?:password|passwd|secret|api.?key|access.?key|db_pass)\s*=\s*([^${\n\s]{4,})"
PORTS = ["5432", "3306", "6379", "27017", "9200", "2181", "8500", "9092"]
PORT = r"['\"]?(?:0\.0\.0\.0:)?(\d+):\d+['\"]?"
EVENT = r"(?i)\$\{\{\s*github\.event\.(?:issue\.title|issue\.body|pull_request\.title|pull_request\.body|head_commit\.message|pages\.[^}]+)"
USES = r"^\s+(?:-\s+)?uses:\s+([^\s@#]+)@([^\s#]+)"
OPEN_INGRESS = r"(?i)cidr_blocks\s*=\s*\[[\"']0\.0\.0\.0/0[\"']\]"
TERRAFORM_SECRET = r"(?i)(?:password|secret|api_key|access_key|private_key|token)\s*=\s*['\"]([^'\"]{8,})['\"]"
IGNORED = r"(^|/)(?:\.git|node_modules|\.venv|venv|__pycache__|\.next|dist|build|target|\.tox)/"
MOST_BYTES, EVIDENCE = 512 * 1024, 120
WORKLOADS = {"Pod", "Deployment", "DaemonSet", "StatefulSet", "ReplicaSet", "Job", "CronJob"}


def config_kind(path: Column) -> Column:
    """dockerfile, compose, workflow, terraform or yaml, the first that fits; else null."""
    p = forward_slashes(path)
    name = F.substring_index(p, "/", -1)
    return (
        F.when(name.rlike(r"^Dockerfile(\.[A-Za-z0-9._-]+)?$"), "dockerfile")
        .when(name.rlike(r"(?i)^docker-compose(\.[A-Za-z0-9._-]+)?\.ya?ml$|^compose\.ya?ml$"), "compose")
        .when(p.rlike(r"\.github/workflows/.*\.ya?ml$"), "workflow")
        .when(p.rlike(r"(?i)\.tf$"), "terraform")
        .when(p.rlike(r"(?i)\.ya?ml$"), "yaml")
    )


def _hit(rule: str, on: Column, evidence: Column | None = None) -> Column:
    severity, confidence = RULES[rule]
    seen = F.lit(None).cast("string") if evidence is None else evidence
    return F.when(on, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), seen.alias("evidence")))


def _documents(files: DataFrame, key: str) -> DataFrame:
    """The rules that need the parsed document; these report line 1. Documents that can't be read have none."""

    @F.pandas_udf("array<string>")
    def read(contents: pd.Series, kinds: pd.Series) -> pd.Series:
        import yaml  # raises where it is missing: no reader must not look like no findings

        def one(text: str, kind: str) -> list[str]:
            try:
                data = yaml.safe_load(text)
            except Exception:  # noqa: BLE001  a broken document is no finding
                return []
            if not isinstance(data, dict):
                return []
            if kind == "workflow":
                events = data.get("on", data.get(True))
                got = ["IAC007"] if str(data.get("permissions")).lower() == "write-all" else []
                return got + (["IAC006"] if isinstance(events, dict) and "pull_request_target" in events else [])
            spec = data.get("spec") if data.get("kind") in WORKLOADS else None
            if not isinstance(spec, dict):
                return []
            template = spec.get("template")
            pod = template.get("spec", spec) if isinstance(template, dict) else spec
            if not isinstance(pod, dict):
                return []
            got = ["IAC011" for k in ("hostNetwork", "hostPID") if pod.get(k) is True]
            for c in pod.get("containers") or []:
                context = c.get("securityContext") if isinstance(c, dict) else None
                if isinstance(context, dict):
                    got += ["IAC010"] if context.get("privileged") is True else []
                    user = context.get("runAsUser")
                    got += ["IAC009"] if context.get("runAsNonRoot") is False or user == 0 and user is not False else []
            return got

        return pd.Series([one(t, k) for t, k in zip(contents, kinds)], dtype=object)

    wanted = (F.col("kind") == "workflow") | (F.col("kind") == "yaml") & F.substring("content", 1, 500).rlike("(?i)(?:apiVersion|kind|metadata|spec):")
    rows = files.withColumn("kind", config_kind(F.col("relative_path"))).where(F.col("content").isNotNull() & wanted)
    hits = rows.select(key, F.col("relative_path").alias("path"), F.explode(read("content", "kind")).alias("rule_id")).distinct()
    severity = F.coalesce(*[F.when(F.col("rule_id") == r, F.lit(s)) for r, (s, _) in RULES.items()])
    confidence = F.coalesce(*[F.when(F.col("rule_id") == r, F.lit(c)) for r, (_, c) in RULES.items()])
    return hits.select(
        key, "path", F.lit(1).alias("line_no"), "rule_id", severity.alias("severity"), confidence.alias("confidence"), F.lit(None).cast("string").alias("evidence")
    )


def audit(files: DataFrame, key: str = "file_id") -> DataFrame:
    """``key, path, line_no, rule_id, severity, confidence, evidence`` of all configuration rules. Null contents have none.

    ``evidence`` is the head of the line for three rules, literals in it masked, else null.

    The rules on single lines take one pass together, the last stage of a Dockerfile a second, parsed documents a third.

    Files below folders of tools and results are left out, as are those of more than 512 KiB.
    """
    files = files.where(~forward_slashes(F.col("relative_path")).rlike(IGNORED) & (F.octet_length("content") <= MOST_BYTES))
    all_lines = delivered_lines(files.where(config_kind(F.col("relative_path")).isNotNull()), key).withColumn("kind", config_kind(F.col("path"))).withColumn("t", F.trim("line"))
    kind = F.col("kind")
    docker = (kind == "dockerfile") & (F.col("t") != "") & ~F.col("t").startswith("#")
    value = F.concat(*[F.regexp_extract("t", IMAGE_SECRET, i) for i in (2, 3, 4)])
    baked = F.regexp_extract("t", IMAGE_SECRET, 1).rlike(SECRET_NAME) & (value != "") & ~value.startswith("${")
    secret = F.regexp_extract("line", COMPOSE_SECRET, 1)
    password = (secret != "") & ~secret.rlike(r"(?i)^(?:\$|changeme|password|secret|example)")
    port = F.regexp_extract("t", PORT, 1).isin(PORTS) & ~F.contains("t", F.lit("127.0.0.1"))
    action, tag = F.regexp_extract("line", USES, 1), F.regexp_extract("line", USES, 2)
    unpinned = (action != "") & ~tag.rlike(r"(?i)^[0-9a-f]{40}$") & ~action.rlike(r"^(\./|docker://)")
    terraform = (kind == "terraform") & ~F.col("t").rlike("^(#|//)")
    literal = F.regexp_extract("line", TERRAFORM_SECRET, 1)
    head = F.substring("t", 1, EVIDENCE)
    masked = F.regexp_replace(head, r"(['\"])([^'\"]{4,})(['\"])", "$1***$3")
    hits = F.array_compact(F.array(
        _hit("IAC003", docker & baked), _hit("IAC004", (kind == "compose") & password), _hit("IAC005", (kind == "compose") & port),
        _hit("IAC015", (kind == "workflow") & F.col("line").rlike(EVENT)), _hit("IAC014", (kind == "workflow") & unpinned, head),
        _hit("IAC012", terraform & F.col("line").rlike(OPEN_INGRESS), head), _hit("IAC013", terraform & (literal != "") & ~literal.rlike(r"^(\$\{|var\.)"), masked),
    ))
    of_lines = all_lines.select(key, "path", "line_no", F.explode(hits).alias("h")).select(key, "path", "line_no", "h.*")
    user = F.lower(F.regexp_extract("t", r"(?i)^USER\s+(\S+)", 1))
    stages = all_lines.where(docker).groupBy(key, "path", "copy_no").agg(
        F.max(F.when(F.col("t").rlike(r"(?i)^FROM\s+\S+"), F.col("line_no"))).alias("line_no"),
        F.max(F.when((user != "") & ~user.isin("0", "root"), F.col("line_no"))).alias("user_at"),
    )
    root = stages.where(F.col("line_no").isNotNull() & (F.coalesce("user_at", F.lit(0)) < F.col("line_no")))
    of_stages = root.select(key, "path", "line_no", _hit("IAC001", F.lit(True)).alias("h")).select(key, "path", "line_no", "h.*")
    return of_lines.unionByName(of_stages).unionByName(_documents(files, key)).distinct()
