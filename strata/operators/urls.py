"""Which URLs point at the public internet, as one native expression: no Python, no shuffle.

Hosts are first brought to a canonical form, as a browser would read them: user info, port and
brackets go, percent escapes are decoded, and IPv4 addresses written as `2130706433`, `0x7f.1` or
`0177.0.0.1` become four numbers. IPv6 text is expanded to eight numbers.

The expression is large, so it is put together as SQL text and handed to Spark once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What makes a host private.
LOCAL_NAMES = ("localhost",)
PRIVATE_NAME_PARTS = ("internal", "corp", "intranet")
PRIVATE_NAME_ENDS = (".local", ".lan")
LOCALHOST_V4 = ("127.0.0.1", "0.0.0.0")
PRIVATE_V4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
)
PUBLIC_V4 = ("192.0.0.9/32", "192.0.0.10/32")
# Everything outside UNICAST_V6 is private, IPv4 written as IPv6 included.
PRIVATE_V6 = ("2001:0::/23", "2001:db8::/32", "2002::/16")
PUBLIC_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
UNICAST_V6 = ("2000::/3", "fec0::/10")

# Characters a host name may not hold.
FORBIDDEN = r"[\x00-\x20#%/:<>?@\\^|\x7f\x{FFFD}\[\]]"

_NUMBER = r"(?:0x[0-9a-f]*|[0-9]+)"
_GROUPS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"


def _let(name: str, value: str, body: str) -> str:
    """Bind a value to a name: it is computed once, however often the body uses it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _v4_range(cidr: str) -> tuple[int, int]:
    address, bits = cidr.split("/")
    first = 0
    for part in address.split("."):
        first = first * 256 + int(part)
    return first, first + 2 ** (32 - int(bits)) - 1


def _v6_groups(address: str) -> list[int]:
    head, _, tail = address.partition("::")
    left = [int(g, 16) for g in head.split(":") if g]
    right = [int(g, 16) for g in tail.split(":") if g]
    return left + [0] * (8 - len(left) - len(right)) + right


def _any(tests: list[str]) -> str:
    return f"({' or '.join(tests)})"


def _in_v4(number: str, cidrs: tuple[str, ...]) -> str:
    return _any([f"{number} between {a} and {b}" for a, b in map(_v4_range, cidrs)])


def _in_v6(groups: str, cidrs: tuple[str, ...]) -> str:
    """Are the 8 groups inside a range? The prefix is compared group by group, the last one by range."""

    def inside(cidr: str) -> str:
        address, bits = cidr.split("/")
        whole, rest = divmod(int(bits), 16)
        want = _v6_groups(address)
        tests = [f"{groups}[{i}] = {want[i]}" for i in range(whole)]
        if rest:
            tests.append(f"{groups}[{whole}] between {want[whole]} and {want[whole] + 2 ** (16 - rest) - 1}")
        return f"({' and '.join(tests)})"

    return _any([inside(c) for c in cidrs])


def _host(url: str) -> str:
    """Host of an http(s) URL, lower case, still in its brackets if IPv6; null if there is none."""
    cleaned = rf"translate(regexp_replace({url}, r'\A[\x00-\x20]+|[\x00-\x20]+\z', ''), '\t\n\r', '')"
    authority = rf"regexp_extract({cleaned}, r'(?i)\Ahttps?:[/\\]*([^/\\?#]*)', 1)"
    after_user = rf"regexp_replace({authority}, r'(?s)\A.*@', '')"
    shape = r"r'\A(\[[^\]]*\]|[^:]*)(?::0*([0-9]*))?\z'"
    port = f"regexp_extract(a, {shape}, 2)"
    port_ok = f"(length({port}) < 5 or length({port}) = 5 and {port} <= '65535')"
    name = f"case when {port_ok} then regexp_extract(a, {shape}, 1) end"
    decoded = (
        "case when contains(n, '%') and not startswith(n, '[') "
        "then try_url_decode(replace(n, '+', '%2B')) else n end"
    )
    checked = rf"case when d <> '' and (startswith(d, '[') or not d rlike r'{FORBIDDEN}') then lower(d) end"
    return _let("d", _let("n", _let("a", after_user, name), decoded), checked)


def _ipv4(host: str) -> str:
    """BIGINT of a host whose last label is a number, or -1 if that is no address."""
    dotless = rf"regexp_replace({host}, r'\.\z', '')"
    digits = r"regexp_replace(p, r'\A(?:0x)?0*', '')"
    part = rf"""case
      when p rlike r'\A0[0-9]*[89]' then null
      when {digits} = '' then 0L
      when length({digits}) > 12 then {2**40}L
      when startswith(p, '0x') then cast(conv({digits}, 16, 10) as bigint)
      when startswith(p, '0') then cast(conv({digits}, 8, 10) as bigint)
      else try_cast({digits} as bigint) end"""
    # The last part fills all the bytes the others leave.
    room = "array(" + ", ".join(f"{256 ** (5 - n)}L" for n in range(1, 5)) + ")[size(v) - 1]"
    leading = "slice(v, 1, size(v) - 1)"
    number = f"""case when forall({leading}, x -> x < 256) and v[size(v) - 1] < {room}
      then aggregate({leading}, 0L, (acc, x) -> acc * 256 + x) * {room} + v[size(v) - 1] end"""
    well_formed = rf"{dotless} rlike r'\A(?:{_NUMBER}\.){{0,3}}{_NUMBER}\z'"
    values = rf"transform(split({dotless}, r'\.'), p -> {part})"
    return f"coalesce(case when {well_formed} then {_let('v', values, number)} end, -1L)"


def _ipv6(host: str) -> str:
    """ARRAY<BIGINT> of the 8 groups of a bracketed host; null if it is no IPv6 address."""
    text = rf"regexp_extract({host}, r'\A\[([^\]]*)\]\z', 1)"
    # A dotted IPv4 tail is written as two groups.
    octet = r"(0|[1-9][0-9]{0,2})"
    dotted = rf"r'\A(.*:){octet}\.{octet}\.{octet}\.{octet}\z'"
    octets = ", ".join(f"cast(regexp_extract(t, {dotted}, {i}) as bigint)" for i in range(2, 6))
    joined = f"""case when forall(o, x -> x < 256) then
      concat(regexp_extract(t, {dotted}, 1), lower(hex(o[0] * 256 + o[1])), ':', lower(hex(o[2] * 256 + o[3]))) end"""
    as_hex = f"""case when not contains(t, '.') then t
      when t rlike {dotted} then {_let('o', f'array({octets})', joined)} end"""
    left = "filter(split(b[0], ':'), g -> g <> '')"
    right = "filter(split(coalesce(get(b, 1), ''), ':'), g -> g <> '')"
    given = f"(size({left}) + size({right}))"
    fill = f"array_repeat('0', greatest(8 - {given}, 0))"
    groups = f"""case when if(size(b) = 2, {given} <= 7, {given} = 8)
      then transform(concat({left}, {fill}, {right}), g -> cast(conv(g, 16, 10) as bigint)) end"""
    shape = rf"r'\A(?:{_GROUPS}|(?:{_GROUPS})?::(?:{_GROUPS})?)\z'"
    parsed = f"case when h rlike {shape} then {_let('b', 'split(h, ' + chr(39) + '::' + chr(39) + ')', groups)} end"
    return _let("h", _let("t", text, as_hex), parsed)


def _v4_class(number: str) -> str:
    local = ", ".join(str(_v4_range(f"{a}/32")[0]) for a in LOCALHOST_V4)
    return f"""case when {number} < 0 then 'invalid'
      when {number} in ({local}) then 'localhost'
      when {_in_v4(number, PRIVATE_V4)} and not {_in_v4(number, PUBLIC_V4)} then 'private_ip'
      else 'public' end"""


def _v6_class(groups: str) -> str:
    private = f"{_in_v6(groups, PRIVATE_V6)} and not {_in_v6(groups, PUBLIC_V6)}"
    return f"""case when {groups} is null then 'invalid'
      when {_in_v6(groups, ('::1/128',))} then 'localhost'
      when not {_in_v6(groups, UNICAST_V6)} or ({private}) then 'private_ip'
      else 'public' end"""


def _name_class(host: str, host_match: str) -> str:
    if host_match not in ("contains", "suffix"):
        raise ValueError(f"unknown host_match: {host_match}")
    name = rf"regexp_replace({host}, r'\.\z', '')"
    at_end = "contains" if host_match == "contains" else "endswith"
    private = [f"contains({name}, '{p}')" for p in PRIVATE_NAME_PARTS]
    private += [f"{at_end}({name}, '{p}')" for p in PRIVATE_NAME_ENDS]
    local = ", ".join(f"'{n}'" for n in LOCAL_NAMES)
    return f"""case when {name} in ({local}) then 'localhost'
      when {_any(private)} then 'private_host' else 'public' end"""


def _host_class(host: str, host_match: str) -> str:
    return rf"""case when {host} is null then 'invalid'
      when startswith({host}, '[') then {_let('s', _ipv6(host), _v6_class('s'))}
      when {host} rlike r'(?:\A|\.){_NUMBER}\.?\z' then {_let('n', _ipv4(host), _v4_class('n'))}
      else {_name_class(host, host_match)} end"""


def url_class(url: str, host_match: str = "contains") -> Column:
    """`invalid`, `localhost`, `private_ip`, `private_host` or `public`; null for a null URL.

    `url` names a column. A trailing dot does not hide a host: `localhost.` is `localhost`.
    """
    column = ".".join(f"`{part}`" for part in url.split("."))
    verdict = _let("host", _host(column), _host_class("host", host_match))
    return F.expr(f"case when {column} is not null then {verdict} end")


def url_host(url: str) -> Column:
    """The canonical host of a URL column; null if the URL has none."""
    return F.expr(_host(".".join(f"`{part}`" for part in url.split("."))))


def screen_urls(
    df: DataFrame, url_col: str, host_match: str = "contains", class_col: str = "url_class"
) -> DataFrame:
    """Add the class of a URL column. `host_match="suffix"` takes .local and .lan as suffixes only."""
    return df.withColumn(class_col, url_class(url_col, host_match))
