"""Link, network and transport layers. A layer reads its window, writes its nodes and names the layer that follows."""

from __future__ import annotations

from dataclasses import dataclass, field

from tidewire.dissect import apps, flow
from tidewire.dissect.fields import ENUMS, enum_name
from tidewire.dissect.tree import Cursor, Tree, Unreadable, ip4_text, mac_text

BAD, GOOD, UNVERIFIED, ABSENT = range(4)  # of a checksum; fixed values
MOST_LAYERS, MOST_PROTOCOLS, MOST_EXTENSIONS = 32, 12, 16  # fixed values
#: bit, field, short name; fixed values
TCP_FLAGS = ((0x800, "res", "RES"), (0x100, "ae", "AE"), (0x080, "cwr", "CWR"), (0x040, "ece", "ECE"), (0x020, "urg", "URG"), (0x010, "ack", "ACK"), (0x008, "push", "PSH"), (0x004, "reset", "RST"), (0x002, "syn", "SYN"), (0x001, "fin", "FIN"))
#: details of ICMP errors by type and code; fixed values
ICMP_DETAILS = {(3, 0): "Destination network unreachable", (3, 1): "Destination host unreachable", (3, 2): "Destination protocol unreachable", (3, 3): "Destination port unreachable", (3, 4): "Fragmentation needed", (3, 13): "Communication administratively filtered", (11, 0): "Time to live exceeded in transit", (11, 1): "Fragment state time exceeded"}
ICMP6_DETAILS = {(1, 0): "No route to destination", (1, 1): "Communication administratively prohibited", (1, 3): "Address unreachable", (1, 4): "Port unreachable", (3, 0): "Hop limit exceeded in transit", (3, 1): "Fragment state time exceeded"}


@dataclass(frozen=True)
class Options:
    """What is verified; the tree has the same shape either way."""

    ip_checksums: bool = True
    transport_checksums: bool = True


@dataclass
class Next:
    proto: str
    source: int
    start: int
    end: int


@dataclass
class Context:
    """One frame on its way through the layers."""

    number: int
    ts: int
    options: Options
    tree: Tree = field(default_factory=Tree)
    sources: list[bytes] = field(default_factory=list)
    protocols: list[str] = field(default_factory=list)
    stream: flow.Stream | None = None  # of the frame's flow, if it has one
    stream_id: int | None = None
    whole: tuple | None = None  # what reassembly says of the frame: ('whole'|'part'|'bad', value, parts)
    src: bytes | None = None
    dst: bytes | None = None
    protocol: str = ""
    info: str = ""
    expert: tuple[int, int, str] | None = None
    net: tuple[bytes, bytes] | None = None
    nesting: int = 0
    side: int | None = None
    origin: str = ""

    def enter(self, name: str, shown: bool = True) -> None:
        if len(self.protocols) < MOST_PROTOCOLS:
            self.protocols.append(name)
        if shown:
            self.protocol = name

    def report(self, severity: int, group: int, summary: str, start: int, end: int) -> None:
        t = self.tree
        t.begin("_ws.expert", start, end, text=summary)
        t.leaf("_ws.expert.severity", 0, 0, u=severity)
        t.leaf("_ws.expert.group", 0, 0, u=group)
        t.close()
        if self.expert is None or severity > self.expert[0]:
            self.expert = (severity, group, summary)

    def malformed(self, start: int, end: int, text: str) -> None:
        self.tree.leaf("_ws.malformed", start, end, text=text)
        self.report(4, 3, "Malformed packet: this layer could not be parsed", start, end)

    def checksum(self, name: str, start: int, end: int, status: int, said: str) -> None:
        self.tree.leaf(f"{name}.checksum.status", start, end, u=status)
        if status == BAD:
            self.tree.leaf("_ws.checksum.bad", start, end, text=said)
            self.report(4, 1, said, start, end)

    def hold(self, rest: bytes) -> bool:
        return self.stream is not None and self.side is not None and self.stream.hold(self.side, rest, self.origin, self.ts)


def ones_sum(*parts: bytes) -> int:
    """Internet checksum: 0 over data that holds a right one."""
    data = b"".join(parts)
    if len(data) % 2:
        data += b"\0"
    total = sum(memoryview(data).cast("H"))  # byte order does not matter to whether it is zero
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def _pseudo(x: Context, proto: int, segment: bytes) -> int:
    if x.net is None:
        return UNVERIFIED
    n = len(segment)
    head = bytes([0, proto]) + n.to_bytes(2, "big") if len(x.net[0]) == 4 else n.to_bytes(4, "big") + bytes([0, 0, 0, proto])
    return BAD if ones_sum(*x.net, head, segment) else GOOD


def data(c: Cursor, x: Context) -> None:
    x.enter("data", shown=False)
    x.tree.begin("data", c.base, c.end)
    x.tree.leaf("data.data", c.base, c.end)
    x.tree.leaf("data.len", c.base, c.end, u=len(c.data))
    x.tree.close()


def by_ethertype(t: int) -> str:
    return {0x0800: "ip", 0x0806: "arp", 0x8100: "vlan", 0x88A8: "vlan", 0x86DD: "ipv6"}.get(t, "data")


def by_ipproto(p: int) -> str:
    return {1: "icmp", 6: "tcp", 17: "udp", 58: "icmpv6"}.get(p, "data")


def by_link(link: int) -> str:
    return {1: "eth", 0: "null", 108: "null", 12: "ip", 228: "ip", 229: "ipv6"}.get(link, "data")


def _then(c: Cursor, x: Context, proto: str, size: int | None = None) -> Next:
    return Next(proto, x.tree.current, c.at, c.end if size is None else min(c.at + size, c.end))


def eth(c: Cursor, x: Context) -> Next:
    values, spans = c.read("m:eth.dst m:eth.src u2:eth.type")
    x.enter("eth")
    x.dst, x.src = values[:2]
    kind = values[2]
    if kind <= 1500:
        spans[2] = ("u", "eth.len", *spans[2][2:])
    x.tree.begin("eth", c.base, c.at)
    x.tree.write(values, spans)
    x.tree.close()
    if kind <= 1500:
        return _then(c, x, "llc", kind)
    if kind not in ENUMS["ethertype"]:
        x.info = f"Ethertype 0x{kind:04x}"
    return _then(c, x, by_ethertype(kind))


def vlan(c: Cursor, x: Context) -> Next:
    (tci, kind), spans = c.read("u2:- u2:vlan.etype")
    x.enter("vlan")
    priority, dei, ident = tci >> 13, bool(tci >> 12 & 1), tci & 0xFFF
    t, (a, b) = x.tree, spans[0][2:]
    t.begin("vlan", c.base, c.at, text=f"802.1Q Virtual LAN, PRI: {priority}, DEI: {int(dei)}, ID: {ident}")
    t.leaf("vlan.priority", a, b, u=priority)
    t.leaf("vlan.dei", a, b, b=dei)
    t.leaf("vlan.id", a, b, u=ident)
    t.write([kind], spans[1:])
    t.close()
    return _then(c, x, by_ethertype(kind))


def llc(c: Cursor, x: Context) -> Next:
    values, spans = c.read("u1:llc.dsap u1:llc.ssap u1:llc.control")
    dsap, ssap, control = values
    if control & 3 != 3:
        c.take(1)
        spans[2] = (*spans[2][:3], c.at)
    x.enter("llc")
    t = x.tree
    node = t.begin("llc", c.base, c.base)
    t.write(values, spans)
    after = "data"
    if (dsap, ssap, control) == (0xAA, 0xAA, 3):
        (oui, pid), spans = c.read("u3:llc.oui u2:llc.type")
        if oui:
            spans[1] = ("u", "llc.pid", *spans[1][2:])
            x.info = f"SNAP OUI 0x{oui:06x} PID 0x{pid:04x}"
        else:
            after = by_ethertype(pid)
        t.write([oui, pid], spans)
        t.text[node] = f"Logical-Link Control (SNAP), OUI 0x{oui:06x}, PID 0x{pid:04x}"
    else:
        t.text[node] = f"Logical-Link Control, DSAP 0x{dsap:02x}, SSAP 0x{ssap:02x}"
        x.info = f"LLC DSAP 0x{dsap:02x} SSAP 0x{ssap:02x}"
    t.close(c.at)
    return _then(c, x, after)


def null(c: Cursor, x: Context) -> Next:
    (big,), spans = c.read("u4:null.family")
    little = int.from_bytes(big.to_bytes(4, "big"), "little")
    family = little if little <= 0xFF else big
    x.enter("null")
    x.tree.begin("null", c.base, c.at)
    x.tree.write([family], spans)
    x.tree.close()
    return _then(c, x, {2: "ip", 24: "ipv6", 28: "ipv6", 30: "ipv6"}.get(family, "data"))


def arp(c: Cursor, x: Context) -> None:
    values, spans = c.read("u2:arp.hw.type u2:arp.proto.type u1:arp.hw.size u1:arp.proto.size u2:arp.opcode")
    hw, proto, hw_size, proto_size, op = values
    x.enter("arp")
    x.tree.begin("arp", c.base, c.base)
    x.tree.write(values, spans)
    if (hw, proto, hw_size, proto_size) == (1, 0x0800, 6, 4):
        (mac, ip, _, target), spans = got = c.read("m:arp.src.hw_mac 4:arp.src.proto_ipv4 m:arp.dst.hw_mac 4:arp.dst.proto_ipv4")
        x.tree.write(*got)
        if op == 1:
            x.info = f"ARP Announcement for {ip4_text(ip)}" if ip == target else f"Who has {ip4_text(target)}? " + ("(ARP Probe)" if not any(ip) else f"Tell {ip4_text(ip)}")
        else:
            x.info = f"{ip4_text(ip)} is at {mac_text(mac)}" if op == 2 else f"ARP opcode {op}"
    else:
        x.tree.write(*c.read(f"x{hw_size}:arp.src.hw x{proto_size}:arp.src.proto x{hw_size}:arp.dst.hw x{proto_size}:arp.dst.proto"))
        x.info = f"ARP hw type {hw}, proto 0x{proto:04x}, opcode {op}"
    x.tree.close(c.at)


def _each_option(c: Cursor, x: Context, one, padding: str | None) -> None:
    """Options until the window or an end marker; what cannot be read is marked."""
    while c.left:
        level = x.tree.level
        try:
            if one(c, x):
                if c.left and padding:
                    x.tree.leaf(padding, c.at, c.end)
                return
        except Unreadable as e:
            x.tree.unwind(level)
            x.malformed(c.at, c.end, f"[Malformed option: {e}]")
            return


def _ip_option(c: Cursor, x: Context) -> bool:
    t, start = x.tree, c.at
    (kind,), spans = c.read("u1:ip.opt.type")
    node = t.begin("ip.opt", start, start)
    t.write([kind], spans)
    if kind < 2:
        t.text[node] = enum_name("ipopt", kind)
        t.close(c.at)
        return kind == 0
    (size,), spans = c.read("u1:ip.opt.len")
    if size < 2:
        raise Unreadable.invalid("IPv4 option length (< 2)", c.at - 1)
    t.write([size], spans)
    at = c.at
    body = c.take(size - 2)
    name = f"Option {kind}"
    if kind == 148 and len(body) == 2:
        t.leaf("ip.opt.ra", at, c.at, u=int.from_bytes(body, "big"))
        t.text[node] = f"Router Alert ({size} bytes): {int.from_bytes(body, 'big')}"
    else:
        if kind in (7, 131, 137) and body:
            t.leaf("ip.opt.ptr", at, at + 1, u=body[0])
            for i in range(1, len(body) - 3, 4):
                t.leaf("ip.opt.route", at + i, at + i + 4, a=body[i : i + 4])
            name = enum_name("ipopt", kind)
        else:
            t.leaf("ip.opt.data", at, c.at)
        t.text[node] = f"{name} ({size} bytes)"
    t.close(c.at)
    return False


def ip(c: Cursor, x: Context) -> Next:
    first = c.take(1)[0]
    header = (first & 15) * 4
    if first >> 4 != 4:
        raise Unreadable.invalid("IP version (expected 4)", c.base)
    if header < 20:
        raise Unreadable.invalid("IPv4 header length (IHL < 5)", c.base)
    values, s = c.read("u1:ip.dsfield u2:ip.len u2:ip.id u2:ip.flags u1:ip.ttl u1:ip.proto u2:ip.checksum 4:ip.src 4:ip.dst")
    ds, total, ident, flags, ttl, proto, checksum, src, dst = values
    more, offset = bool(flags & 0x2000), (flags & 0x1FFF) * 8
    x.enter("ip")
    x.src, x.dst, x.net = src, dst, (src, dst)
    t = x.tree
    t.begin("ip", c.base, c.base)
    t.leaf("ip.version", c.base, c.base + 1, u=4)
    t.leaf("ip.hdr_len", c.base, c.base + 1, u=header)
    t.bits("ip.dsfield", *s[0][2:], ds, [("ip.dsfield.dscp", ds >> 2), ("ip.dsfield.ecn", ds & 3)])
    t.write(values[1:3], s[1:3])
    set_ = [n for bit, n in ((0x8000, "Reserved"), (0x4000, "Don't fragment"), (0x2000, "More fragments")) if flags & bit]
    t.bits("ip.flags", *s[3][2:], flags >> 13, [("ip.flags.rb", bool(flags & 0x8000)), ("ip.flags.df", bool(flags & 0x4000)), ("ip.flags.mf", more)], f"Flags: 0x{flags >> 13:x}" + (f" ({', '.join(set_)})" if set_ else ""))
    t.leaf("ip.frag_offset", *s[3][2:], u=offset)
    t.write(values[4:7], s[4:7])
    head = c.data[:header]
    x.checksum("ip", *s[6][2:], UNVERIFIED if not x.options.ip_checksums or not checksum or len(head) < header else BAD if ones_sum(head) else GOOD, "Bad IPv4 header checksum")
    t.write(values[7:], s[7:])
    if header > 20:
        o = c.sub(header - 20)
        t.begin("ip.options", o.base, o.end, text=f"Options: ({header - 20} bytes)")
        _each_option(o, x, _ip_option, "ip.opt.padding")
        t.close()
    offload = total == 0 and c.left > 0
    size = c.left if offload else min(max(total - header, 0), c.left)
    after, name = by_ipproto(proto), enum_name("ipproto", proto)
    if offload:
        t.leaf("ip.len_tso", *s[1][2:], b=True, text=f"[Total length 0: segmentation offload, {size} bytes captured]")
    if after == "data":
        x.info = f"{name} ({proto})"
    if not (more or offset):
        t.close(c.at)
        return _then(c, x, after, size)
    x.info = f"Fragmented IP protocol (proto={name} {proto}, off={offset}, ID={ident:04x})"
    state, value, parts = x.whole if x.whole and not x.nesting else ("bad", "nested fragment", []) if x.nesting else ("part", None, [])
    if state == "whole":
        x.sources.append(value)
        back, t.current = t.current, len(x.sources)
        t.begin("ip.fragments", 0, len(value), text=f"[{len(parts)} IPv4 Fragments ({len(value)} bytes)]")
        for frame, at, n in parts:
            t.leaf("ip.fragment", at, at + n, text=f"[Frame: {frame}, payload: {at}-{at + n} ({n} bytes)]")
        t.leaf("ip.fragment.count", 0, 0, u=len(parts))
        t.leaf("ip.reassembled.length", 0, 0, u=len(value))
        t.leaf("ip.reassembled.data", 0, len(value))
        t.close()
        t.current = back
        t.close(c.at)
        return Next(after, len(x.sources), 0, len(value))
    t.begin("ip.fragment", c.at, c.at, text=f"[Fragment of IPv4 datagram ID 0x{ident:04x}, offset {offset}]")
    if state == "bad":
        x.malformed(0, 0, f"[Reassembly rejected: {value}]")
    t.close()
    t.close(c.at)
    return _then(c, x, "data", size)


def _ip6_option(c: Cursor, x: Context) -> bool:
    t, start = x.tree, c.at
    (kind,), spans = c.read("u1:ipv6.opt.type")
    node = t.begin("ipv6.opt", start, start)
    t.write([kind], spans)
    if kind == 0:
        t.text[node] = "Pad1"
    else:
        (size,), spans = c.read("u1:ipv6.opt.length")
        t.write([size], spans)
        at, body = c.at, c.take(size)
        if kind == 1:
            t.text[node] = f"PadN ({size + 2} bytes)"
        elif kind == 5 and size == 2:
            t.leaf("ipv6.opt.router_alert", at, c.at, u=int.from_bytes(body, "big"))
            t.text[node] = f"Router Alert: {int.from_bytes(body, 'big')}"
        else:
            t.leaf("ipv6.opt.data", at, c.at)
            t.text[node] = f"Option {kind} ({size + 2} bytes)"
    t.close(c.at)
    return False


def _extension(c: Cursor, x: Context, kind: int) -> tuple[int, bool]:
    """One extension header: the next one's number, and whether the packet is a fragment."""
    t, start = x.tree, c.at
    if kind == 44:
        values, spans = c.read("u1:ipv6.fraghdr.nxt u1:ipv6.fraghdr.reserved_octet u2:- u4:ipv6.fraghdr.ident")
        offset, more = (values[2] >> 3) * 8, bool(values[2] & 1)
        t.begin("ipv6.fraghdr", start, c.at, text=f"Fragment Header, offset {offset}, more {'yes' if more else 'no'}, ID 0x{values[3]:08x}")
        t.write(values[:2], spans[:2])
        a, b = spans[2][2:]
        t.leaf("ipv6.fraghdr.offset", a, b, u=offset)
        t.leaf("ipv6.fraghdr.reserved_bits", a, b, u=values[2] >> 1 & 3)
        t.leaf("ipv6.fraghdr.more", a, b, b=more)
        t.write(values[3:], spans[3:])
        t.close()
        return values[0], more or offset > 0
    if kind == 43:
        values, spans = c.read("u1:ipv6.routing.nxt u1:ipv6.routing.len u1:ipv6.routing.type u1:ipv6.routing.segleft")
        t.begin("ipv6.routing", start, start, text=f"Routing Header, Type {values[2]}, Segments Left {values[3]}")
        t.write(values, spans)
        r = c.sub((values[1] + 1) * 8 - 4)
        if values[2] in (0, 2, 4):
            t.leaf("ipv6.routing.data", r.at, r.at + 4)
            r.take(4)
            while r.left >= 16:
                at = r.at
                t.leaf("ipv6.routing.addr", at, at + 16, a=r.take(16))
        if r.left or values[2] not in (0, 2, 4):
            t.leaf("ipv6.routing.data", r.at, r.end)
    else:
        name, said = ("hopopts", "Hop-by-Hop Options") if kind == 0 else ("dstopts", "Destination Options")
        values, spans = c.read(f"u1:ipv6.{name}.nxt u1:ipv6.{name}.len")
        size = (values[1] + 1) * 8
        t.begin(f"ipv6.{name}", start, start, text=f"{said} ({size} bytes)")
        t.write(values, spans)
        _each_option(c.sub(size - 2), x, _ip6_option, None)
    t.close(c.at)
    return values[0], False


def ipv6(c: Cursor, x: Context) -> Next | None:
    values, s = c.read("u4:- u2:ipv6.plen u1:ipv6.nxt u1:ipv6.hlim 6:ipv6.src 6:ipv6.dst")
    word, size, after, _, src, dst = values
    if word >> 28 != 6:
        raise Unreadable.invalid("IP version (expected 6)", c.base)
    x.enter("ipv6")
    x.src, x.dst, x.net = src, dst, (src, dst)
    t, (a, b) = x.tree, s[0][2:]
    t.begin("ipv6", c.base, c.base)
    for name, v in (("version", 6), ("tclass", word >> 20 & 0xFF), ("flow", word & 0xFFFFF)):
        t.leaf(f"ipv6.{name}", a, b, u=v)
    t.write(values[1:], s[1:])
    p, fragment = c.sub(min(size, c.left)), False
    for _ in range(MOST_EXTENSIONS):
        if after not in (0, 43, 44, 60):
            break
        after, part = _extension(p, x, after)
        fragment |= part
    t.close(c.at)
    if fragment:
        x.info = f"Fragmented IPv6 (proto={enum_name('ipproto', after)} {after})"
        return _then(p, x, "data")
    if after == 59:
        x.info = "No next header"
        return None
    return _then(p, x, by_ipproto(after))


def _quoted(c: Cursor, x: Context) -> None:
    """The datagram an ICMP error quotes: its nodes stay, its addresses and protocols do not become the frame's."""
    if x.nesting >= 2:
        return
    kept = (x.src, x.dst, x.protocol, x.info, x.expert, x.net, len(x.protocols))
    x.nesting += 1
    proto, window = "ip", Cursor(c.rest(), c.at)
    layers = {"ip": ip, "tcp": tcp, "udp": udp, "icmp": icmp}
    for _ in range(4):
        start = window.at
        try:
            after = layers.get(proto, data)(window, x)
        except Unreadable as e:
            x.malformed(start, c.end, f"[Malformed Packet: {proto}] {e}")
            break
        if after is None or after.source != x.tree.current or after.start >= c.end:
            break
        proto, window = after.proto, Cursor(c.data[after.start - c.base : after.end - c.base], after.start)
    x.nesting -= 1
    x.src, x.dst, x.protocol, x.info, x.expert, x.net, n = kept
    del x.protocols[n:]


def icmp(c: Cursor, x: Context) -> None:
    values, spans = c.read("u1:icmp.type u1:icmp.code u2:icmp.checksum")
    kind, code, _ = values
    x.enter("icmp")
    name, t = enum_name("icmp", kind), x.tree
    t.begin("icmp", c.base, c.end)
    t.write(values, spans)
    x.checksum("icmp", *spans[2][2:], UNVERIFIED if not x.options.ip_checksums else BAD if ones_sum(c.data) else GOOD, "Bad ICMP checksum")
    if kind in (0, 8, 13, 14):
        values, spans = c.read("u2:icmp.ident u2:icmp.seq")
        t.write(values, spans)
        x.info = f"{name} id=0x{values[0]:04x}, seq={values[1]}"
        if c.left:
            t.leaf("icmp.data", c.at, c.end)
    elif kind in (3, 4, 5, 11, 12):
        values, spans = c.read("u2:icmp.unused u2:icmp.mtu" if (kind, code) == (3, 4) else "4:icmp.gateway" if kind == 5 else "u1:icmp.pointer u3:icmp.unused" if kind == 12 else "u4:icmp.unused")
        t.write([0 if f == "icmp.unused" and len(spans) > 1 else v for v, (_, f, *_) in zip(values, spans)], spans)
        x.info = ICMP_DETAILS.get((kind, code), name)
        if c.left:
            _quoted(c, x)
    else:
        x.info = f"{name} (type {kind}, code {code})"
        if c.left:
            t.leaf("icmp.data", c.at, c.end)
    t.close()


def _nd_option(c: Cursor, x: Context) -> bool:
    t, start = x.tree, c.at
    (kind,), spans = c.read("u1:icmpv6.opt.type")
    node = t.begin("icmpv6.opt", start, start)
    t.write([kind], spans)
    (size,), spans = c.read("u1:icmpv6.opt.length")
    t.write([size], spans)
    if size == 0:
        raise Unreadable.invalid("ICMPv6 option length 0", c.at - 1)
    b = c.sub(size * 8 - 2)
    if kind in (1, 2) and b.left >= 6:
        (mac,), spans = b.read("m:icmpv6.opt.linkaddr")
        t.write([mac], spans)
        said = f"{'Source' if kind == 1 else 'Target'} link-layer address: {mac_text(mac)}"
    elif kind == 3 and b.left >= 30:
        values, spans = b.read("u1:icmpv6.opt.prefix.length u1:- u4:icmpv6.opt.prefix.valid_lifetime u4:icmpv6.opt.prefix.preferred_lifetime u4:- 6:icmpv6.opt.prefix")
        t.write(values, spans)
        said = f"Prefix information: {apps.addr_text(values[5])}/{values[0]}"
    elif kind == 5 and b.left >= 6:
        values, spans = b.read("u2:- u4:icmpv6.opt.mtu")
        t.write(values, spans)
        said = f"MTU: {values[1]}"
    else:
        t.leaf("icmpv6.opt.data", b.at, b.end)
        said = f"type {kind}, {size * 8} bytes"
    t.text[node] = f"ICMPv6 Option ({said})"
    t.close(c.at)
    return False


def icmpv6(c: Cursor, x: Context) -> None:
    values, spans = c.read("u1:icmpv6.type u1:icmpv6.code u2:icmpv6.checksum")
    kind, code, _ = values
    x.enter("icmpv6")
    name, t, show = enum_name("icmpv6", kind), x.tree, apps.addr_text
    t.begin("icmpv6", c.base, c.end)
    t.write(values, spans)
    x.checksum("icmpv6", *spans[2][2:], _pseudo(x, 58, c.data) if x.options.transport_checksums else UNVERIFIED, "Bad ICMPv6 checksum")
    options, rest = kind in (133, 134, 135, 136, 137), True
    if kind in (128, 129):
        values, spans = c.read("u2:icmpv6.echo.identifier u2:icmpv6.echo.sequence_number")
        t.write(values, spans)
        x.info = f"{name} id=0x{values[0]:04x}, seq={values[1]}"
    elif kind == 133:
        t.write(*c.read("u4:icmpv6.reserved"))
        x.info = "Router Solicitation"
    elif kind == 134:
        values, s = c.read("u1:icmpv6.nd.ra.cur_hop_limit u1:- u2:icmpv6.nd.ra.router_lifetime u4:icmpv6.nd.ra.reachable_time u4:icmpv6.nd.ra.retrans_timer")
        t.write(values[:1], s[:1])
        t.bits("icmpv6.nd.ra.flag", *s[1][2:], values[1], [("icmpv6.nd.ra.flag.m", bool(values[1] & 0x80)), ("icmpv6.nd.ra.flag.o", bool(values[1] & 0x40))])
        t.write(values[2:], s[2:])
        x.info = "Router Advertisement"
    elif kind == 135:
        values, s = c.read("u4:icmpv6.reserved 6:icmpv6.nd.ns.target_address")
        t.write(values, s)
        x.info = f"Neighbor Solicitation for {show(values[1])}"
    elif kind == 136:
        values, s = c.read("u4:- 6:icmpv6.nd.na.target_address")
        marks = [(f"icmpv6.nd.na.flag.{n}", bool(values[0] >> bit & 1), said) for n, bit, said in (("r", 31, "rtr"), ("s", 30, "sol"), ("o", 29, "ovr"))]
        t.bits("icmpv6.nd.na.flag", *s[0][2:], values[0] >> 29, [m[:2] for m in marks])
        t.write(values[1:], s[1:])
        x.info = f"Neighbor Advertisement {show(values[1])} is at ({', '.join(m[2] for m in marks if m[1])})"
    elif kind == 137:
        values, s = c.read("u4:icmpv6.reserved 6:icmpv6.nd.rd.target_address 6:icmpv6.nd.rd.destination_address")
        t.write(values, s)
        x.info = f"Redirect {show(values[2])} to {show(values[1])}"
    elif kind in (1, 2, 3, 4):
        values, s = c.read({2: "u4:icmpv6.mtu", 4: "u4:icmpv6.pointer"}.get(kind, "u4:icmpv6.reserved"))
        t.write(values, s)
        x.info = {2: f"Packet Too Big (MTU {values[0]})", 4: f"Parameter Problem (pointer {values[0]})"}.get(kind, ICMP6_DETAILS.get((kind, code), name))
    else:
        x.info = f"{name} (type {kind}, code {code})"
    if options:
        _each_option(c, x, _nd_option, None)
    elif rest and c.left:
        t.leaf("icmpv6.data", c.at, c.end)
    t.close()


def _stream(x: Context, name: str) -> None:
    if x.stream_id is not None and x.net is not None:
        x.tree.leaf(f"{name}.stream", 0, 0, u=x.stream_id)


def udp(c: Cursor, x: Context) -> Next | None:
    values, s = c.read("u2:udp.srcport u2:udp.dstport u2:udp.length u2:udp.checksum")
    src, dst, size, checksum = values
    if size < 8:
        raise Unreadable.invalid("UDP length (< 8)", s[2][2])
    x.enter("udp")
    x.info = f"{src} → {dst} Len={size - 8}"
    t = x.tree
    t.begin("udp", c.base, c.at)
    t.write(values[:2], s[:2])
    _stream(x, "udp")
    t.write(values[2:], s[2:])
    status = ABSENT if checksum == 0 else UNVERIFIED if not x.options.transport_checksums or len(c.data) < size else _pseudo(x, 17, c.data[:size])
    x.checksum("udp", *s[3][2:], status, "Bad UDP checksum")
    t.close()
    n = min(size - 8, c.left)
    if not n:
        return None
    t.aside("udp.payload", c.at, c.at + n)
    ports = {src, dst}
    return _then(c, x, "dns" if ports & {53, 5353} else "dhcp" if ports & {67, 68} else "data", n)


def _tcp_option(c: Cursor, x: Context) -> bool:
    t, start = x.tree, c.at
    (kind,), spans = c.read("u1:tcp.option_kind")
    if kind < 2:
        t.begin("tcp.options.nop" if kind else "tcp.options.eol", start, c.at)
        t.write([kind], spans)
        t.close()
        return kind == 0
    (size,), more = c.read("u1:tcp.option_len")
    if size < 2:
        raise Unreadable.invalid("TCP option length (< 2)", c.at - 1)
    n = size - 2
    name = {(2, 2): "mss", (3, 1): "wscale", (4, 0): "sack_perm", (8, 8): "timestamp"}.get((kind, n)) or ("sack" if kind == 5 and n % 8 == 0 else "unknown")
    node = t.begin(f"tcp.options.{name}", start, start)
    t.write([kind, size], spans + more)
    if name == "mss":
        values, s = c.read("u2:tcp.options.mss_val")
        t.write(values, s)
        said = f"Maximum segment size: {values[0]} bytes"
    elif name == "wscale":
        (shift,), s = c.read("u1:tcp.options.wscale.shift")
        t.write([shift], s)
        t.leaf("tcp.options.wscale.multiplier", *s[0][2:], u=1 << min(shift, 14))
        said = f"Window scale: {shift} (multiply by {1 << min(shift, 14)})"
    elif name == "sack_perm":
        said = "SACK permitted"
    elif name == "sack":
        edges = []
        for _ in range(n // 8):
            values, s = c.read("u4:tcp.options.sack_le u4:tcp.options.sack_re")
            t.write(values, s)
            edges.append("-".join(map(str, values)))
        said = " ".join(["SACK:", *edges])
    elif name == "timestamp":
        values, s = c.read("u4:tcp.options.timestamp.tsval u4:tcp.options.timestamp.tsecr")
        t.write(values, s)
        said = f"Timestamps: TSval {values[0]}, TSecr {values[1]}"
    else:
        t.write(*c.read(f"x{n}:tcp.options.data"))
        said = f"Option kind {kind} ({size} bytes)"
    t.text[node] = said
    t.close(c.at)
    return False


def window_scale(options: bytes) -> int | None:
    i = 0
    while i < len(options):
        kind = options[i]
        if kind == 0:
            return None
        if kind == 1:
            i += 1
            continue
        size = options[i + 1] if i + 1 < len(options) else 0
        if kind == 3:
            return options[i + 2] if size == 3 and i + 2 < len(options) else None
        if size < 2:
            return None
        i += size
    return None


def _analysis(x: Context, at: int, seen: flow.Seen) -> None:
    names = seen.names()
    if not names and not seen.in_flight:
        return
    t = x.tree
    t.begin("tcp.analysis", at, at, text="[SEQ/ACK analysis]")
    if seen.in_flight:
        t.leaf("tcp.analysis.bytes_in_flight", 0, 0, u=seen.in_flight)
    for n in names:
        severity, said = flow.FINDINGS[n]
        t.leaf(f"tcp.analysis.{n}", 0, 0, text=said)
        x.report(severity, 2, said, 0, 0)
        if n == "duplicate_ack":
            t.leaf("tcp.analysis.duplicate_ack_num", 0, 0, u=seen.ack_number)
            t.leaf("tcp.analysis.duplicate_ack_frame", 0, 0, u=seen.ack_frame)
    t.close()


def tcp(c: Cursor, x: Context) -> Next | None:
    values, s = c.read("u2:tcp.srcport u2:tcp.dstport u4:tcp.seq u4:tcp.ack u2:tcp.flags u2:tcp.window_size_value u2:tcp.checksum u2:tcp.urgent_pointer")
    sport, dport, seq, ack, word, window, _, _ = values
    header, flags = (word >> 12) * 4, word & 0xFFF
    if header < 20:
        raise Unreadable.invalid("TCP header length (data offset < 5)", s[4][2])
    names = ", ".join(n for bit, _, n in reversed(TCP_FLAGS) if flags & bit)
    size = max(len(c.data) - header, 0)
    x.enter("tcp")
    x.info = f"{sport} → {dport} [{names}] Seq={seq} Ack={ack} Win={window} Len={size}"
    t, syn, fin, rst = x.tree, bool(flags & 2), bool(flags & 1), bool(flags & 4)
    t.begin("tcp", c.base, c.base)
    t.write(values[:2], s[:2])
    seen = None
    if x.stream is not None and x.net is not None:
        x.side = x.stream.side_of((x.net[0], sport))
        seen = x.stream.observe(x.side, x.number, x.ts, seq, ack, size, window, syn, fin, rst, bool(flags & 16), window_scale(c.data[20:header]) if syn else None)
        _stream(x, "tcp")
    t.leaf("tcp.len", 0, 0, u=size)
    t.write(values[2:4], s[2:4])
    a, b = s[4][2:]
    t.leaf("tcp.hdr_len", a, a + 1, u=header)
    t.bits("tcp.flags", a, b, flags, [(f"tcp.flags.{n}", bool(flags & bit)) for bit, n, _ in TCP_FLAGS], f"Flags: 0x{flags:03x} ({names})")
    t.write(values[5:7], s[5:7])
    x.checksum("tcp", *s[6][2:], _pseudo(x, 6, c.data) if x.options.transport_checksums else UNVERIFIED, "Bad TCP checksum")
    t.write(values[7:], s[7:])
    if header > 20:
        o = c.sub(header - 20)
        t.begin("tcp.options", o.base, o.end, text=f"Options: ({header - 20} bytes)")
        _each_option(o, x, _tcp_option, "tcp.options.data")
        t.close()
    if seen is not None:
        _analysis(x, c.base, seen)
        if rst or fin:
            x.stream.drop(x.side)
    t.close(c.at)
    if not size:
        return None
    t.aside("tcp.payload", c.at, c.end)
    payload = c.rest()
    held = x.stream.release(x.side, x.ts) if seen is not None and seen.sequence is None else None
    if held:
        x.origin = held[1]
        x.sources.append(held[0] + payload)
        return Next(held[1], len(x.sources), 0, len(x.sources[-1]))
    ports = {sport, dport}
    x.origin = "tls" if apps.is_tls(payload) else "http" if apps.is_http(payload) else "tls" if ports & {443, 8443} else "http" if ports & {80, 8080} else "data"
    return _then(c, x, x.origin)


LAYERS = {"eth": eth, "vlan": vlan, "llc": llc, "null": null, "arp": arp, "ip": ip, "ipv6": ipv6, "icmp": icmp, "icmpv6": icmpv6, "udp": udp, "tcp": tcp, "data": data, "dns": apps.dns, "dhcp": apps.dhcp, "http": apps.http, "tls": apps.tls}


def frame(raw: bytes, link: int, number: int, ts: int, orig_len: int, options: Options = Options(), stream: flow.Stream | None = None, stream_id: int | None = None, whole: tuple | None = None) -> Context:
    """A frame through all its layers. ts: nanoseconds."""
    x = Context(number, ts, options, stream=stream, stream_id=stream_id, whole=whole)
    t = x.tree
    t.begin("frame", 0, len(raw))
    t.leaf("frame.number", 0, 0, u=number)
    t.leaf("frame.time_epoch", 0, 0, s=f"{ts // 10**9}.{ts % 10**9:09d}")
    t.leaf("frame.len", 0, 0, u=orig_len)
    t.leaf("frame.cap_len", 0, 0, u=len(raw))
    t.leaf("frame.encap_type", 0, 0, u=max(link, 0))
    chain = t.leaf("frame.protocols", 0, 0, s="")
    t.close()
    t.covered = 0
    after = Next(by_link(link), 0, 0, len(raw))
    for _ in range(MOST_LAYERS):
        source = raw if after.source == 0 else x.sources[after.source - 1]
        t.current = after.source
        window, first, level, proto, start = Cursor(source[after.start : after.end], after.start), len(t.field), t.level, after.proto, after.start
        try:
            after = LAYERS[proto](window, x)
        except Unreadable as e:
            t.unwind(level)
            if len(t.field) > first:
                t.end[first] = max(t.end[first:])
            text = f"[Malformed Packet: {proto}] {e}"
            t.begin("_ws.malformed", start, len(source), text=text)
            x.report(4, 3, "Malformed packet: this layer could not be parsed", start, len(source))
            if start < len(source):
                data(window, x)
            t.close()
            x.info, x.protocol, after = text, proto, None
        if after is None:
            break
    t.current = 0
    if t.covered < len(raw):
        tail = raw[t.covered :]
        name, said = ("data.data", "Trailing data") if link != 1 else ("eth.trailer", "Trailer") if any(tail) else ("eth.padding", "Padding")
        t.leaf(name, len(raw) - len(tail), len(raw), text=f"{said}: {len(tail)} bytes")
    t.s[chain] = ":".join(x.protocols)
    x.protocol = x.protocol or "RAW"
    return x
