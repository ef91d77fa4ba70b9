"""Column parsers for log lines, node names, addresses and flow records.

A parser yields null, never an empty string, when its pattern does not match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the log formats.
BLOCK_PATTERN = r"(blk_-?\d+)"
TRANSFER_PATTERN = r"src: /(\d+\.\d+\.\d+\.\d+):\d+ dest: /(\d+\.\d+\.\d+\.\d+):\d+"
STORED_PATTERN = r"addStoredBlock: blockMap updated: (\d+\.\d+\.\d+\.\d+):\d+ is added to (blk_-?\d+)"
NODE_PATTERN = r"^(R\d+)-(M\d+)-(N[0-9A-F]+)"
IP_PATTERN = r"\b\d+\.\d+\.\d+\.\d+\b"
RACK_PATTERN = r"\bR\d{2}\b"
REREPLICATION_TEMPLATE = "E16"
EXCEPTION_TEMPLATES = ["E7", "E10", "E14", "E27", "E8", "E13"]
PRIVATE_PREFIXES = ["192.168.", "10.", "172.16."]
IPV4_PATTERN = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.|$)){4}(?<!\.)$"
# eight groups of up to four hex digits, or fewer around one "::"
IPV6_PATTERN = (r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}"
                r"|(?=(?:[0-9A-Fa-f]*:){2,7}[0-9A-Fa-f]*$)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)$")
# 10.0.0.0/8, 172.16.0.0/12, 192.168.0.0/16 and 100.64.0.0/10 on valid addresses
PRIVATE_PATTERN = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.)"
PROTOCOL_NAMES = {"6": "tcp", "17": "udp", "1": "icmp"}
EPHEMERAL_PORT = 32768
OPEN_RANGES = ["0.0.0.0/0", "::/0"]
REPUTATION_WORDS = ["reputation", "cins", "drop", "dshield", "compromised"]


def group_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_key(text: Column, pattern: str = BLOCK_PATTERN) -> Column:
    return group_or_null(text, pattern)


def compose_ts(date: Column, time: Column) -> Column:
    """yyMMdd plus HHmmss whose leading zeros may be lost."""
    return F.to_timestamp_ntz(F.concat(F.lit("20"), date, F.lpad(time, 6, "0")), F.lit("yyyyMMddHHmmss"))


def epoch_to_ts(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds.cast("bigint")).cast("timestamp_ntz")


def ts_to_epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def drop_unkeyed(df: DataFrame, key: str) -> DataFrame:
    return df.dropna(subset=[key])


def extract_transfers(df: DataFrame, text: str, key: str) -> DataFrame:
    pairs = df.select(
        group_or_null(F.col(text), TRANSFER_PATTERN, 1).alias("src_ip"),
        group_or_null(F.col(text), TRANSFER_PATTERN, 2).alias("dst_ip"),
        F.col(key).alias("block_id"),
    )
    return pairs.dropna(subset=["src_ip", "dst_ip"])


def extract_placement(df: DataFrame, text: str) -> DataFrame:
    pairs = df.select(
        group_or_null(F.col(text), STORED_PATTERN, 1).alias("host_ip"),
        group_or_null(F.col(text), STORED_PATTERN, 2).alias("block_id"),
    )
    return pairs.dropna().distinct()


def extract_rereplication(df: DataFrame, text: str, template: str, key: str) -> DataFrame:
    """Source and target of re-replication lines; a side that does not match stays ''."""
    return df.filter(F.col(template) == REREPLICATION_TEMPLATE).select(
        F.regexp_extract(text, r"^(\d+\.\d+\.\d+\.\d+)", 1).alias("src_ip"),
        F.regexp_extract(text, r"to /(\d+\.\d+\.\d+\.\d+)", 1).alias("dst_ip"),
        F.col(key).alias("block_id"),
    )


def extract_links(df: DataFrame, text: str, template: str, key: str) -> DataFrame:
    """Every address field of a line side by side, so that the texts are read once for all link tables."""
    line, moved = F.col(text), F.col(template) == REREPLICATION_TEMPLATE
    return df.select(
        F.col(key).alias("block_id"),
        group_or_null(line, TRANSFER_PATTERN, 1).alias("sent_from"), group_or_null(line, TRANSFER_PATTERN, 2).alias("sent_to"),
        group_or_null(line, STORED_PATTERN, 1).alias("stored_host"), group_or_null(line, STORED_PATTERN, 2).alias("stored_block"),
        F.when(moved, F.regexp_extract(line, r"^(\d+\.\d+\.\d+\.\d+)", 1)).alias("moved_from"),
        F.when(moved, F.regexp_extract(line, r"to /(\d+\.\d+\.\d+\.\d+)", 1)).alias("moved_to"),
    )


def link_tables(links: DataFrame) -> dict[str, DataFrame]:
    """transfers, stored replicas, re-replications, blocks and hosts from extracted links."""
    transfers = links.select(F.col("sent_from").alias("src_ip"), F.col("sent_to").alias("dst_ip"), "block_id").dropna(
        subset=["src_ip", "dst_ip"])
    stored = links.select(F.col("stored_host").alias("host_ip"), F.col("stored_block").alias("block_id")).dropna().distinct()
    moves = links.filter(F.col("moved_from").isNotNull()).select(
        F.col("moved_from").alias("src_ip"), F.col("moved_to").alias("dst_ip"), "block_id")
    named = links.select(F.explode(F.array("sent_from", "sent_to", "stored_host")).alias("ip"))
    return {"transfers": transfers, "stored": stored, "moves": moves, "blocks": links.select("block_id").dropna().distinct(),
            "hosts": named.dropna().distinct()}


def parse_hierarchy(node: Column) -> list[Column]:
    return [group_or_null(node, NODE_PATTERN, g).alias(n) for g, n in ((1, "rack"), (2, "midplane"), (3, "node_card"))]


def derive_alert_flag(label: Column) -> Column:
    return label != "-"


def subnet16(ip: Column) -> Column:
    return F.concat(F.split_part(ip, F.lit("."), F.lit(1)), F.lit("."), F.split_part(ip, F.lit("."), F.lit(2)),
                    F.lit(".0.0/16"))


def crosses_subnet(a: Column, b: Column) -> Column:
    """Compares the second octet only."""
    return F.split_part(a, F.lit("."), F.lit(2)) != F.split_part(b, F.lit("."), F.lit(2))


def is_external_prefix(ip: Column) -> Column:
    inside = F.lit(False)
    for prefix in PRIVATE_PREFIXES:
        inside = inside | ip.startswith(prefix)
    return ~inside


def is_external_cidr(ip: Column) -> Column:
    """Outside the private ranges; an address that cannot be parsed is not external."""
    return F.coalesce((ip.rlike(IPV4_PATTERN) & ~ip.rlike(PRIVATE_PATTERN)) | ip.rlike(IPV6_PATTERN), F.lit(False))


def parse_flow_record(df: DataFrame, line: str, *keep: str) -> DataFrame:
    """Space-separated flow record; short lines and records without a source are dropped."""
    f = [F.get(F.col("_f"), F.lit(i)) for i in range(11)]
    names = F.create_map(*[F.lit(x) for pair in PROTOCOL_NAMES.items() for x in pair])
    digits = F.when(f[6].rlike(r"^\d+$"), f[6].try_cast("int"))
    return (
        # exploding a one-element array keeps later filters from splitting the line again per field
        df.select(*keep, F.explode(F.array(F.split(F.trim(F.col(line)), r"\s+"))).alias("_f"))
        .filter((F.size("_f") >= 12) & (f[3] != "-"))
        .select(
            *keep,
            f[0].try_cast("bigint").alias("start_s"), f[1].try_cast("bigint").alias("end_s"), f[2].alias("eni"),
            f[3].alias("src"), f[4].alias("dst"), f[5].alias("sport"), digits.alias("dport"),
            F.coalesce(F.try_element_at(names, f[7]), f[7]).alias("proto"),
            f[8].try_cast("bigint").alias("packets"), f[9].try_cast("bigint").alias("bytes"), f[10].alias("action"),
        )
    )


def is_reply(action: Column, dport: Column) -> Column:
    return (action == "ACCEPT") & (dport >= EPHEMERAL_PORT)


def inbound_external(df: DataFrame) -> DataFrame:
    return df.filter(is_external_cidr(F.col("src")) & ~is_external_cidr(F.col("dst")) & F.col("dport").isNotNull())


def inbound_unsolicited(df: DataFrame) -> DataFrame:
    return inbound_external(df).filter(~is_reply(F.col("action"), F.col("dport")))


def is_reputation_signature(signature: Column) -> Column:
    return signature.rlike("(?i)" + "|".join(REPUTATION_WORDS))


def normalise_port_range(proto: Column, low: Column, high: Column) -> tuple[Column, Column]:
    everything = (proto == "-1") | low.isNull()
    lo = F.when(everything, F.lit(0)).otherwise(F.greatest(low, F.lit(0)))
    hi = F.when(everything, F.lit(65535)).otherwise(F.greatest(high, F.lit(0)))
    return lo.cast("int"), hi.cast("int")


def open_to_internet(cidrs: Column) -> Column:
    return F.coalesce(F.arrays_overlap(cidrs, F.array(*[F.lit(c) for c in OPEN_RANGES])), F.lit(False))


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def extract_entities(text: Column) -> list[Column]:
    return [
        F.array_distinct(find_all(text, r"blk_-?\d+")).alias("blocks"),
        F.array_distinct(find_all(text, IP_PATTERN)).alias("hosts"),
        find_all(text, RACK_PATTERN).alias("racks"),
    ]


def route_question(text: Column) -> list[Column]:
    # The routing keywords.
    hosts = r"(?i)\bhosts?\b|datanode"
    racks = r"(?i)\brack|BGL"
    scanners = r"(?i)scanning|scanners?\b|which sources?|attack sources|top attackers|probing"
    no_ip = F.size(find_all(text, IP_PATTERN)) == 0
    return [
        (text.rlike(hosts) & no_ip).alias("wants_all_hosts"),
        (text.rlike(racks) | text.rlike(RACK_PATTERN)).alias("wants_racks"),
        text.rlike(scanners).alias("wants_scanners"),
    ]


def combined_verdict(exceptions: Column, flag: Column, risk: Column, threshold) -> Column:
    return (exceptions | F.coalesce(flag, F.lit(False)) | (F.coalesce(risk, F.lit(0.0)) >= threshold))


def has_exception(templates: Column) -> Column:
    return F.arrays_overlap(templates, F.array(*[F.lit(e) for e in EXCEPTION_TEMPLATES]))


def exception_events(templates: Column) -> Column:
    return F.array_intersect(templates, F.array(*[F.lit(e) for e in EXCEPTION_TEMPLATES]))


# Suffixes tried in this order.
SUFFIXES = ["ing", "ed", "es", "s"]


def stem(token: Column) -> Column:
    """Strip the first suffix that fits a token longer than 4 and does not follow a digit."""
    out = F
    for suffix in SUFFIXES:
        before = F.substring(token, -len(suffix) - 1, 1)
        fits = (F.length(token) > 4) & token.endswith(suffix) & ~before.between("0", "9")
        cut = F.substring(token, F.lit(1), F.length(token) - len(suffix))
        out = out.when(fits, cut)
    return out.otherwise(token)


def raw_tokens(text: Column) -> Column:
    return find_all(F.lower(text), r"[a-z0-9_.]+")


def tokenize(text: Column, stemmed: bool = True) -> Column:
    return F.transform(raw_tokens(text), stem) if stemmed else raw_tokens(text)


def words(text: Column) -> Column:
    """Whitespace tokens."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def first_line(text: Column) -> Column:
    """First non-blank line, trimmed."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.regexp_replace(F.split_part(trimmed, F.lit("\n"), F.lit(1)), r"\s+$", "")
