"""Scalar string functions over Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import fixed


def rx(pattern: str, ascii_only: bool = False) -> str:
    """A pattern with the character classes and newline rules it was written for.

    Unicode letters, digits and spaces, the four separators \\x1c-\\x1f as space, and ``.`` that stops
    at a line feed only. ``ascii_only`` is the faster equivalent for lines known to be plain ASCII
    without those separators.
    """
    if ascii_only:
        return "(?d)" + pattern
    out, i, bracket = [], 0, False
    while i < len(pattern):
        pair = pattern[i:i + 2]
        if pair in (r"\s", r"\S"):
            inner = r"\s\x1c-\x1f"
            out.append(inner if bracket else f"[{inner}]" if pair == r"\s" else f"[^{inner}]")
            i += 2
        elif pair[0] == "\\":
            out.append(pair)
            i += 2
        else:
            bracket = pair[0] == "[" or (bracket and pair[0] != "]")
            out.append(pair[0])
            i += 1
    return "(?dU)" + "".join(out)


def plain_ascii(c: Column) -> Column:
    """True when :func:`rx` with ``ascii_only`` means the same for this text."""
    odd = c.contains("\x1c") | c.contains("\x1d") | c.contains("\x1e") | c.contains("\x1f")
    return (F.octet_length(c) == F.length(c)) & ~odd


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def group_or_blank(c: Column, pattern: str, literal: str | None = None) -> Column:
    """Group 1 of the first match or ''; ``literal`` is a substring every match must contain."""
    hit = F.regexp_extract(c, rx(pattern), 1)
    return F.when(c.contains(literal), hit).otherwise("") if literal else hit


def first_group(c: Column, pattern: str, literal: str | None = None) -> Column:
    """Group 1 of the first match or NULL."""
    return first_non_blank(group_or_blank(c, pattern, literal))


def first_non_blank(*values: Column) -> Column:
    """The first value that is not ''. Each is evaluated once, unlike with ``coalesce(nullif(...))``."""
    return F.get(F.filter(F.array(*values), lambda v: v != ""), F.lit(0))


def has_word(c: Column, word: str) -> Column:
    return c.contains(word) & c.rlike(rx(rf"\b{word}\b"))


def extract_interface(message: Column) -> Column:
    """P5: interface name from the first pattern that matches, without trailing punctuation."""
    hit = first_non_blank(*[group_or_blank(message, p, lit) for lit, p in fixed.INTERFACE_PATTERNS])
    return F.coalesce(F.rtrim(hit, F.lit(",.;:")), F.lit(""))


def extract_neighbor(message: Column) -> Column:
    return group_or_blank(message, fixed.NEIGHBOR_PATTERN, "neighbor")


def extract_as_number(raw: Column) -> Column:
    return group_or_blank(raw, fixed.AS_PATTERN, "(AS").try_cast("bigint")


def extract_vrf(raw: Column) -> Column:
    return group_or_blank(raw, fixed.VRF_PATTERN, "(VRF:")


def interface_in_message(message: Column) -> Column:
    return first_group(message, fixed.MSG_INTERFACE_PATTERN)


def neighbor_in_message(message: Column, scan: int | None = None) -> Column:
    """The neighbor named in a message, or in its first ``scan`` characters."""
    return first_group(message if scan is None else F.substring(message, 1, scan), fixed.MSG_NEIGHBOR_PATTERN)


def normalise_interface(name: Column) -> Column:
    """``_`` between an ASCII alphanumeric and a digit becomes ``/`` (lookup key only)."""
    return F.when(
        name.contains("_"), F.regexp_replace(name, r"(?U)(?<=[a-zA-Z0-9])_(?=\d)", "/")
    ).otherwise(name)


def derive_client(description: Column) -> Column:
    """The description, or its first token when it is longer than 50 characters."""
    return F.when(F.length(description) <= 50, description).otherwise(
        F.regexp_extract(description, rx(r"^[^\s/]*"), 0)
    )


def is_recovery(mnemonic: Column, message: Column, rule_id: Column | None = None) -> Column:
    """Whether an event reports that something came back."""
    by_text = (
        (mnemonic.isin(fixed.RECOVERY_ALWAYS) & ~message.contains("no longer"))
        | (mnemonic.isin(fixed.RECOVERY_CLEAR) & has_word(message, "Clear"))
        | (mnemonic.isin(fixed.RECOVERY_UP) & has_word(message, "Up"))
    )
    return by_text if rule_id is None else rule_id.isin(fixed.RECOVERY_RULES) | by_text


def bgp_discriminator(neighbor: Column, as_number: Column, message: Column) -> Column:
    return F.coalesce(
        blank_to_null(neighbor),
        neighbor_in_message(message),
        F.when(as_number != 0, as_number.cast("string")),
        F.lit(""),
    )


def incident_group_key(device, mnemonic, interface, neighbor, as_number, message) -> Column:
    """P20: identity of an incident card, whatever the alert that carries it."""
    iface = F.coalesce(blank_to_null(interface), interface_in_message(message), F.lit(""))
    return F.when(
        mnemonic == "ADJCHANGE",
        F.concat(device, F.lit(":ADJCHANGE:"), bgp_discriminator(neighbor, as_number, message)),
    ).otherwise(F.concat(device, F.lit(":"), mnemonic, F.lit(":"), iface))


def recovery_state_key(device, mnemonic, interface, neighbor, as_number, message) -> Column:
    """The broader key under which a fault and its recovery meet."""
    iface = F.coalesce(blank_to_null(interface), interface_in_message(message))
    return (
        F.when(
            mnemonic == "ADJCHANGE",
            F.concat(device, F.lit(":BGP:"), bgp_discriminator(neighbor, as_number, message)),
        )
        .when(iface.isNotNull(), F.concat(device, F.lit(":"), iface))
        .otherwise(F.concat(device, F.lit(":"), mnemonic, F.lit(":"), F.coalesce(neighbor, F.lit(""))))
    )


def shorten_interface(name: Column) -> Column:
    return reduce(
        lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), fixed.INTERFACE_SHORT, name
    )


def _bgp_state(message: Column) -> Column:
    return (
        F.when(message.contains("Interface flap") | message.contains("Flap"), "Flap")
        .when(has_word(message, "Down"), "DOWN")
        .when(has_word(message, "Up"), "UP")
    )


def _fault_type(message: Column) -> Column:
    local, remote = message.contains("Local Fault"), message.contains("Remote Fault")
    return (
        F.when(local & remote, "Local+Remote Fault")
        .when(local, "Local Fault")
        .when(remote, "Remote Fault")
        .otherwise("Fault")
    )


def incident_title(mnemonic, device, message, interface, as_name) -> Column:
    """Display title; absent parts drop out because ``concat_ws`` skips NULL."""
    iface = shorten_interface(blank_to_null(interface))
    head = F.concat(mnemonic, F.lit(" — "), device)
    bundle = F.concat(F.lit("BE"), first_group(message, r"Bundle-Ether(\d+)", "Bundle-Ether"))
    label = F.when(message.contains("no longer"), "Bundle DOWN — ").otherwise("Bundle ACTIVE — ")
    updown = F.when(message.contains("Down"), "Down").when(message.contains("Up"), "Up")
    return (
        F.when(mnemonic == "ACTIVE", F.concat_ws(", ", F.concat(label, device), iface, bundle))
        .when(
            mnemonic == "ADJCHANGE",
            F.concat_ws(
                " - ",
                F.concat_ws(" ", F.concat(F.lit("ADJCHANGE — "), device), _bgp_state(message)),
                blank_to_null(as_name),
            ),
        )
        .when(
            mnemonic.isin("RFI", "RX_FAULT"),
            F.concat_ws(" - ", F.concat(F.lit("RXFault-"), device), iface, _fault_type(message)),
        )
        .when(
            mnemonic.isin("UPDOWN", "LINEPROTO"),
            F.concat_ws(" - ", F.concat_ws(" ", head, updown), iface),
        )
        .otherwise(F.concat_ws(", ", head, iface))
    )


def sanitise(value: Column, max_len: int = fixed.MAX_FIELD_LEN) -> Column:
    """P25: drop control characters, cut to ``max_len`` with an ellipsis."""
    clean = F.regexp_replace(value, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.when(
        F.length(clean) > max_len, F.concat(F.substring(clean, 1, max_len - 1), F.lit("…"))
    ).otherwise(clean)


def render_template(template: Column, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` placeholders; a missing value renders as an empty string."""
    for name, value in fields.items():
        template = F.replace(
            template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit(""))
        )
    return template
