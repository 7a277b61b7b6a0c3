"""Field registry: every field's kind, and the names of enumerated values.

A field is declared once, by its protocol, in a line `kind: names`; names are relative to the protocol, `@` is the
protocol itself. Kinds: p protocol, g group, b boolean, u unsigned, s string, x bytes, m MAC, 4 IPv4, 6 IPv6, and
e:TABLE an unsigned value with names. Aliases stand for several fields at once.
"""

from __future__ import annotations

from dataclasses import dataclass

# fixed values: names of enumerated values, as public registries have them
ENUMS: dict[str, dict[int, str]] = {
    "link": {0: "NULL/Loopback", 1: "Ethernet", 12: "Raw IP", 101: "Raw IP", 105: "IEEE 802.11 wireless LAN", 108: "OpenBSD loopback", 113: "Linux cooked capture v1", 127: "IEEE 802.11 plus radiotap", 228: "Raw IPv4", 229: "Raw IPv6", 276: "Linux cooked capture v2"},
    "ethertype": {0x0800: "IPv4", 0x0806: "ARP", 0x8035: "RARP", 0x809B: "AppleTalk", 0x8100: "802.1Q Virtual LAN", 0x86DD: "IPv6", 0x8808: "Ethernet flow control", 0x8847: "MPLS unicast", 0x8848: "MPLS multicast", 0x8863: "PPPoE Discovery", 0x8864: "PPPoE Session", 0x888E: "802.1X Authentication", 0x88A8: "802.1ad Provider Bridge", 0x88CC: "LLDP", 0x88E5: "MACsec", 0x8906: "FCoE", 0x9000: "Loopback"},
    "ipproto": {0: "IPv6 Hop-by-Hop Option", 1: "ICMP", 2: "IGMP", 4: "IPv4", 6: "TCP", 17: "UDP", 41: "IPv6", 43: "IPv6 Routing", 44: "IPv6 Fragment", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 59: "IPv6 No Next Header", 60: "IPv6 Destination Option", 89: "OSPF", 132: "SCTP", 136: "UDPLite"},
    "checksum": {0: "Bad", 1: "Good", 2: "Unverified", 3: "Not present"},
    "severity": {0: "Comment", 1: "Chat", 2: "Note", 3: "Warning", 4: "Error"},
    "group": {0: "Protocol", 1: "Checksum", 2: "Sequence", 3: "Malformed", 4: "Reassemble", 5: "Security"},
    "arphw": {1: "Ethernet", 6: "IEEE 802", 15: "Frame Relay"},
    "arpop": {1: "request", 2: "reply", 3: "reverse request", 4: "reverse reply"},
    "ipopt": {0: "End of Options List (EOL)", 1: "No-Operation (NOP)", 7: "Record Route", 68: "Time Stamp", 130: "Security", 131: "Loose Source Route", 137: "Strict Source Route", 148: "Router Alert"},
    "ip6opt": {0: "Pad1", 1: "PadN", 5: "Router Alert", 194: "Jumbo Payload"},
    "routing": {0: "Source Route", 2: "Type 2 Routing", 3: "RPL Source Route", 4: "Segment Routing"},
    "icmp": {0: "Echo (ping) reply", 3: "Destination Unreachable", 4: "Source Quench", 5: "Redirect", 8: "Echo (ping) request", 9: "Router Advertisement", 10: "Router Solicitation", 11: "Time-to-live exceeded", 12: "Parameter Problem", 13: "Timestamp", 14: "Timestamp Reply"},
    "icmpv6": {1: "Destination Unreachable", 2: "Packet Too Big", 3: "Time Exceeded", 4: "Parameter Problem", 128: "Echo (ping) request", 129: "Echo (ping) reply", 130: "Multicast Listener Query", 131: "Multicast Listener Report", 132: "Multicast Listener Done", 133: "Router Solicitation", 134: "Router Advertisement", 135: "Neighbor Solicitation", 136: "Neighbor Advertisement", 137: "Redirect", 143: "Multicast Listener Report Message v2"},
    "ndopt": {1: "Source link-layer address", 2: "Target link-layer address", 3: "Prefix information", 4: "Redirected header", 5: "MTU", 25: "Recursive DNS Server"},
    "tcpopt": {0: "End of Option List (EOL)", 1: "No-Operation (NOP)", 2: "Maximum segment size", 3: "Window scale", 4: "SACK permitted", 5: "SACK", 8: "Time Stamp Option", 30: "Multipath TCP", 34: "TCP Fast Open Cookie"},
    "dnstype": {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 41: "OPT", 43: "DS", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 65: "HTTPS", 255: "ANY"},
    "dnsclass": {1: "IN", 3: "CH", 4: "HS", 255: "ANY"},
    "dnsop": {0: "Standard query", 1: "Inverse query", 2: "Server status request", 4: "Notify", 5: "Update"},
    "dnsrcode": {0: "No error", 1: "Format error", 2: "Server failure", 3: "No such name", 4: "Not implemented", 5: "Refused"},
    "dhcpop": {1: "Boot Request", 2: "Boot Reply"},
    "dhcpmsg": {1: "Discover", 2: "Offer", 3: "Request", 4: "Decline", 5: "ACK", 6: "NAK", 7: "Release", 8: "Inform"},
    "dhcpopt": {0: "Pad", 1: "Subnet Mask", 3: "Router", 6: "Domain Name Server", 12: "Host Name", 15: "Domain Name", 28: "Broadcast Address", 42: "NTP Servers", 50: "Requested IP Address", 51: "IP Address Lease Time", 53: "DHCP Message Type", 54: "DHCP Server Identifier", 55: "Parameter Request List", 57: "Maximum DHCP Message Size", 58: "Renewal Time Value", 59: "Rebinding Time Value", 60: "Vendor class identifier", 61: "Client identifier", 255: "End"},
    "tlstype": {20: "Change Cipher Spec", 21: "Alert", 22: "Handshake", 23: "Application Data", 24: "Heartbeat"},
    "tlsversion": {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"},
    "tlshs": {0: "Hello Request", 1: "Client Hello", 2: "Server Hello", 4: "New Session Ticket", 8: "Encrypted Extensions", 11: "Certificate", 12: "Server Key Exchange", 13: "Certificate Request", 14: "Server Hello Done", 15: "Certificate Verify", 16: "Client Key Exchange", 20: "Finished"},
    "tlslevel": {1: "Warning", 2: "Fatal"},
    "tlsalert": {0: "Close Notify", 10: "Unexpected Message", 20: "Bad Record MAC", 40: "Handshake Failure", 42: "Bad Certificate", 46: "Certificate Unknown", 48: "Unknown CA", 70: "Protocol Version", 80: "Internal Error", 112: "Unrecognized Name"},
    "tlsext": {0: "server_name", 1: "max_fragment_length", 5: "status_request", 10: "supported_groups", 11: "ec_point_formats", 13: "signature_algorithms", 16: "application_layer_protocol_negotiation", 18: "signed_certificate_timestamp", 21: "padding", 23: "extended_master_secret", 27: "compress_certificate", 35: "session_ticket", 41: "pre_shared_key", 42: "early_data", 43: "supported_versions", 44: "cookie", 45: "psk_key_exchange_modes", 49: "post_handshake_auth", 50: "signature_algorithms_cert", 51: "key_share", 65281: "renegotiation_info"},
    "tlssuite": {0x0000: "TLS_NULL_WITH_NULL_NULL", 0x0005: "TLS_RSA_WITH_RC4_128_SHA", 0x000A: "TLS_RSA_WITH_3DES_EDE_CBC_SHA", 0x002F: "TLS_RSA_WITH_AES_128_CBC_SHA", 0x0035: "TLS_RSA_WITH_AES_256_CBC_SHA", 0x003C: "TLS_RSA_WITH_AES_128_CBC_SHA256", 0x003D: "TLS_RSA_WITH_AES_256_CBC_SHA256", 0x009C: "TLS_RSA_WITH_AES_128_GCM_SHA256", 0x009D: "TLS_RSA_WITH_AES_256_GCM_SHA384", 0x00FF: "TLS_EMPTY_RENEGOTIATION_INFO_SCSV", 0x1301: "TLS_AES_128_GCM_SHA256", 0x1302: "TLS_AES_256_GCM_SHA384", 0x1303: "TLS_CHACHA20_POLY1305_SHA256", 0x1304: "TLS_AES_128_CCM_SHA256", 0xC009: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA", 0xC00A: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA", 0xC013: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA", 0xC014: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA", 0xC023: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA256", 0xC024: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA384", 0xC027: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA256", 0xC028: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA384", 0xC02B: "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256", 0xC02C: "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384", 0xC02F: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", 0xC030: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384", 0xCCA8: "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305_SHA256", 0xCCA9: "TLS_ECDHE_ECDSA_WITH_CHACHA20_POLY1305_SHA256"},
}

KINDS = {"p": "protocol", "g": "group", "b": "bool", "u": "unsigned", "s": "string", "x": "bytes", "m": "mac", "4": "ipv4", "6": "ipv6", "e": "enum"}

DECLARED = {
    "frame": "p: @; u: number len cap_len; s: time_epoch protocols; e:link: encap_type",
    "_ws": "g: expert; b: checksum.bad; e:severity: expert.severity; e:group: expert.group; p: malformed",
    "data": "p: @; x: data; u: len",
    "null": "p: @; u: family",
    "eth": "p: @; m: dst src; e:ethertype: type; u: len; x: padding trailer",
    "vlan": "p: @; u: priority id; b: dei; e:ethertype: etype",
    "llc": "p: @; u: dsap ssap control oui pid; e:ethertype: type",
    "arp": "p: @; e:arphw: hw.type; e:ethertype: proto.type; u: hw.size proto.size; e:arpop: opcode; m: src.hw_mac dst.hw_mac; 4: src.proto_ipv4 dst.proto_ipv4; x: src.hw src.proto dst.hw dst.proto",
    "ip": "p: @; u: version hdr_len dsfield dsfield.dscp dsfield.ecn len id flags frag_offset ttl checksum opt.len opt.ra opt.ptr fragment.count reassembled.length; b: len_tso flags.rb flags.df flags.mf; e:ipproto: proto; e:checksum: checksum.status; 4: src dst opt.route; g: options opt fragment fragments; e:ipopt: opt.type; x: opt.data opt.padding reassembled.data",
    "ipv6": "p: @; u: version tclass flow plen hlim hopopts.len dstopts.len opt.length opt.router_alert routing.len routing.segleft fraghdr.reserved_octet fraghdr.offset fraghdr.reserved_bits fraghdr.ident; e:ipproto: nxt hopopts.nxt dstopts.nxt routing.nxt fraghdr.nxt; 6: src dst routing.addr; g: hopopts dstopts opt routing fraghdr; e:ip6opt: opt.type; e:routing: routing.type; x: opt.data routing.data; b: fraghdr.more",
    "icmp": "p: @; e:icmp: type; u: code checksum ident seq unused mtu pointer; e:checksum: checksum.status; 4: gateway; x: data",
    "icmpv6": "p: @; e:icmpv6: type; u: code checksum reserved echo.identifier echo.sequence_number mtu pointer nd.na.flag nd.ra.cur_hop_limit nd.ra.flag nd.ra.router_lifetime nd.ra.reachable_time nd.ra.retrans_timer opt.length opt.mtu opt.prefix.length opt.prefix.valid_lifetime opt.prefix.preferred_lifetime; e:checksum: checksum.status; 6: nd.ns.target_address nd.na.target_address nd.rd.target_address nd.rd.destination_address opt.prefix; b: nd.na.flag.r nd.na.flag.s nd.na.flag.o nd.ra.flag.m nd.ra.flag.o; g: opt; e:ndopt: opt.type; m: opt.linkaddr; x: opt.data data",
    "udp": "p: @; u: stream srcport dstport length checksum; e:checksum: checksum.status; x: payload",
    "tcp": "p: @; u: stream srcport dstport len seq ack hdr_len flags window_size_value checksum urgent_pointer analysis.bytes_in_flight analysis.duplicate_ack_num analysis.duplicate_ack_frame option_len options.mss_val options.wscale.shift options.wscale.multiplier options.sack_le options.sack_re options.timestamp.tsval options.timestamp.tsecr; g: analysis options options.eol options.nop options.mss options.wscale options.sack_perm options.sack options.timestamp options.unknown; b: analysis.retransmission analysis.fast_retransmission analysis.spurious_retransmission analysis.out_of_order analysis.overlap analysis.lost_segment analysis.duplicate_ack analysis.zero_window analysis.window_full analysis.keep_alive analysis.ack_lost_segment flags.res flags.ae flags.cwr flags.ece flags.urg flags.ack flags.push flags.reset flags.syn flags.fin; e:checksum: checksum.status; e:tcpopt: option_kind; x: options.data payload",
    "dns": "p: @; u: id flags count.queries count.answers count.auth_rr count.add_rr resp.ttl resp.len mx.preference soa.serial_number soa.refresh_interval soa.retry_interval soa.expire_limit soa.minimum_ttl srv.priority srv.weight srv.port; b: flags.response flags.authoritative flags.truncated flags.recdesired flags.recavail flags.z flags.authenticated flags.checkdisable; e:dnsop: flags.opcode; e:dnsrcode: flags.rcode; g: queries answers authority additional qry resp; s: qry.name resp.name cname ns ptr.domain_name mx.mail_exchange txt soa.mname soa.rname srv.target; e:dnstype: qry.type resp.type; e:dnsclass: qry.class resp.class; 4: a; 6: aaaa; x: resp.data",
    "dhcp": "p: @; e:dhcpop: type; e:arphw: hw.type; u: hw.len hops id secs flags cookie option.length option.ip_address_lease_time option.renewal_time_value option.rebinding_time_value option.dhcp_max_message_size; b: flags.bc; 4: ip.client ip.your ip.server ip.relay option.subnet_mask option.router option.domain_name_server option.broadcast_address option.ntp_server option.requested_ip_address option.dhcp_server_id; m: hw.mac_addr; x: hw.addr_padding option.value option.client_id option.padding; s: server file option.hostname option.domain_name option.vendor_class_id; g: option option.end; e:dhcpopt: option.type option.request_list_item; e:dhcpmsg: option.dhcp",
    "http": "p: @; g: request response segment; s: request.method request.uri request.version request.line response.version response.phrase response.line host user_agent content_type transfer_encoding server connection; u: response.code content_length segment.len; x: file_data",
    "tls": "p: @; g: record change_cipher_spec alert_message handshake handshake.ciphersuites handshake.comp_methods handshake.extension segment; e:tlstype: record.content_type record.opaque_type; e:tlsversion: record.version handshake.version handshake.extensions.supported_version; u: record.length handshake.length handshake.session_id_length handshake.cipher_suites_length handshake.comp_methods_length handshake.comp_method handshake.extensions_length handshake.extension.len handshake.extensions_server_name_list_len handshake.extensions_server_name_type handshake.extensions_server_name_len handshake.extensions.supported_versions_len handshake.extensions_alpn_len handshake.extensions_alpn_str_len handshake.certificates_length handshake.certificate_length segment.len; e:tlslevel: alert_message.level; e:tlsalert: alert_message.desc; e:tlshs: handshake.type; e:tlssuite: handshake.ciphersuite; e:tlsext: handshake.extension.type; s: handshake.extensions_server_name handshake.extensions_alpn_str; x: handshake.random handshake.session_id handshake.extension.data handshake.certificate app_data handshake.encrypted continuation_data",
}
ALIASES = {"eth.addr": ("eth.src", "eth.dst"), "ip.addr": ("ip.src", "ip.dst"), "ipv6.addr": ("ipv6.src", "ipv6.dst"), "arp.addr": ("arp.src.proto_ipv4", "arp.dst.proto_ipv4"), "tcp.port": ("tcp.srcport", "tcp.dstport"), "udp.port": ("udp.srcport", "udp.dstport")}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    enum: str | None = None
    members: tuple[str, ...] = ()

    @property
    def ids(self) -> tuple[str, ...]:
        return self.members or (self.name,)


def _declared() -> dict[str, Field]:
    out = {}
    for proto, text in DECLARED.items():
        for part in text.split("; "):
            kind, names = part.rsplit(": ", 1)
            code, _, enum = kind.partition(":")
            for n in names.split():
                name = proto if n == "@" else f"{proto}.{n}"
                out[name] = Field(name, KINDS[code], enum or None)
    for alias, members in ALIASES.items():
        out[alias] = Field(alias, out[members[0]].kind, None, members)
    return out


FIELDS = _declared()


def enum_name(table: str, value: int, default: str = "Unknown") -> str:
    return ENUMS[table].get(value, default)


#: labels by the last part of a name, whatever the protocol; fixed values
LAST = {
    "status": "Checksum Status", "type": "Type", "etype": "Type", "len": "Length", "length": "Length", "nxt": "Next Header", "hdr_len": "Header Length",
    "src": "Source Address", "dst": "Destination Address", "srcport": "Source Port", "dstport": "Destination Port", "stream": "Stream index",
    "opt": "Option", "ptr": "Pointer", "ident": "Identification", "mtu": "MTU", "id": "ID", "dei": "DEI", "dsap": "DSAP", "ssap": "SSAP", "z": "Z",
    "target_address": "Target Address", "destination_address": "Destination Address", "router_alert": "Router Alert", "option_len": "Length", "option_kind": "Kind",
    "hw_mac": "hardware address", "cname": "CNAME", "txt": "TXT", "uri": "URI", "dhcp": "DHCP", "user_agent": "User-Agent",
}
#: labels of fields whose names do not tell them; fixed values
OWN = {
    "frame.number": "Frame Number", "frame.time_epoch": "Epoch Time", "frame.len": "Frame Length", "frame.cap_len": "Capture Length", "frame.encap_type": "Encapsulation type", "frame.protocols": "Protocols in frame",
    "_ws.expert": "Expert Info", "_ws.checksum.bad": "Bad checksum", "_ws.expert.severity": "Severity level", "_ws.malformed": "Malformed Packet",
    "null": "Null/Loopback", "eth": "Ethernet II", "eth.dst": "Destination", "eth.src": "Source", "vlan": "802.1Q Virtual LAN",
    "llc": "Logical-Link Control", "llc.control": "Control field", "llc.oui": "Organization Code", "llc.pid": "Protocol ID",
    "arp": "Address Resolution Protocol", "arp.hw.type": "Hardware type", "arp.proto.type": "Protocol type", "arp.hw.size": "Hardware size", "arp.proto.size": "Protocol size", "arp.src.hw_mac": "Sender MAC address", "arp.src.proto_ipv4": "Sender IP address", "arp.dst.hw_mac": "Target MAC address", "arp.dst.proto_ipv4": "Target IP address", "arp.src.hw": "Sender hardware address", "arp.src.proto": "Sender protocol address", "arp.dst.hw": "Target hardware address", "arp.dst.proto": "Target protocol address",
    "ip": "Internet Protocol Version 4", "ip.dsfield": "Differentiated Services Field", "ip.dsfield.dscp": "Differentiated Services Codepoint", "ip.dsfield.ecn": "Explicit Congestion Notification", "ip.len": "Total Length", "ip.len_tso": "Segmentation offload", "ip.id": "Identification", "ip.flags.rb": "Reserved bit", "ip.flags.df": "Don't fragment", "ip.flags.mf": "More fragments", "ip.frag_offset": "Fragment Offset", "ip.ttl": "Time to Live", "ip.proto": "Protocol", "ip.checksum": "Header Checksum", "ip.checksum.status": "Header checksum status", "ip.opt.data": "Option data", "ip.opt.ra": "Router Alert", "ip.opt.route": "Route address", "ip.fragment": "IPv4 Fragment", "ip.fragments": "IPv4 Fragments", "ip.fragment.count": "Fragment count", "ip.reassembled.length": "Reassembled IPv4 length", "ip.reassembled.data": "Reassembled IPv4 data",
    "ipv6": "Internet Protocol Version 6", "ipv6.tclass": "Traffic Class", "ipv6.flow": "Flow Label", "ipv6.plen": "Payload Length", "ipv6.hlim": "Hop Limit", "ipv6.hopopts": "Hop-by-Hop Options", "ipv6.dstopts": "Destination Options", "ipv6.routing": "Routing Header", "ipv6.routing.segleft": "Segments Left", "ipv6.routing.data": "Type-specific data", "ipv6.routing.addr": "Address", "ipv6.fraghdr": "Fragment Header", "ipv6.fraghdr.nxt": "Next header", "ipv6.fraghdr.more": "More Fragments",
    "icmp": "Internet Control Message Protocol", "icmp.ident": "Identifier", "icmp.seq": "Sequence Number", "icmp.mtu": "MTU of next hop", "icmp.gateway": "Gateway Address",
    "icmpv6": "Internet Control Message Protocol v6", "icmpv6.echo.sequence_number": "Sequence", "icmpv6.nd.na.flag": "Flags", "icmpv6.nd.na.flag.r": "Router", "icmpv6.nd.na.flag.s": "Solicited", "icmpv6.nd.na.flag.o": "Override", "icmpv6.nd.ra.flag": "Flags", "icmpv6.nd.ra.flag.m": "Managed address configuration", "icmpv6.nd.ra.flag.o": "Other configuration", "icmpv6.nd.ra.router_lifetime": "Router lifetime (s)", "icmpv6.nd.ra.reachable_time": "Reachable time (ms)", "icmpv6.nd.ra.retrans_timer": "Retrans timer (ms)", "icmpv6.opt": "ICMPv6 Option", "icmpv6.opt.linkaddr": "Link-layer address", "icmpv6.opt.prefix.length": "Prefix Length", "icmpv6.opt.prefix.valid_lifetime": "Valid Lifetime", "icmpv6.opt.prefix.preferred_lifetime": "Preferred Lifetime",
    "udp": "User Datagram Protocol", "udp.payload": "UDP payload",
    "tcp": "Transmission Control Protocol", "tcp.analysis": "SEQ/ACK analysis", "tcp.analysis.out_of_order": "Out-of-order segment", "tcp.analysis.overlap": "Overlapping segment", "tcp.analysis.lost_segment": "Previous segment not captured", "tcp.analysis.duplicate_ack": "Duplicate ACK", "tcp.analysis.duplicate_ack_num": "Duplicate ACK number", "tcp.analysis.duplicate_ack_frame": "Duplicate to the ACK in frame", "tcp.analysis.keep_alive": "Keep-alive", "tcp.analysis.ack_lost_segment": "ACK to an uncaptured segment", "tcp.len": "TCP Segment Len", "tcp.seq": "Sequence Number (raw)", "tcp.ack": "Acknowledgment Number (raw)", "tcp.flags.res": "Reserved", "tcp.flags.ae": "Accurate ECN", "tcp.flags.cwr": "Congestion Window Reduced", "tcp.flags.ece": "ECN-Echo", "tcp.flags.urg": "Urgent", "tcp.flags.ack": "Acknowledgment", "tcp.flags.syn": "Syn", "tcp.flags.fin": "Fin", "tcp.window_size_value": "Window", "tcp.urgent_pointer": "Urgent Pointer", "tcp.options.eol": "End of Option List (EOL)", "tcp.options.nop": "No-Operation (NOP)", "tcp.options.mss": "Maximum segment size", "tcp.options.mss_val": "MSS Value", "tcp.options.wscale": "Window scale", "tcp.options.wscale.shift": "Shift count", "tcp.options.sack_perm": "SACK permitted", "tcp.options.sack": "SACK", "tcp.options.sack_le": "SACK Left Edge", "tcp.options.sack_re": "SACK Right Edge", "tcp.options.timestamp": "Timestamps", "tcp.options.timestamp.tsval": "Timestamp value", "tcp.options.timestamp.tsecr": "Timestamp echo reply", "tcp.options.unknown": "Unknown option", "tcp.options.data": "Option data", "tcp.payload": "TCP payload",
    "dns": "Domain Name System", "dns.id": "Transaction ID", "dns.flags.recdesired": "Recursion desired", "dns.flags.recavail": "Recursion available", "dns.flags.authenticated": "Answer authenticated", "dns.flags.checkdisable": "Non-authenticated data", "dns.flags.rcode": "Reply code", "dns.count.queries": "Questions", "dns.count.answers": "Answer RRs", "dns.count.auth_rr": "Authority RRs", "dns.count.add_rr": "Additional RRs", "dns.authority": "Authoritative nameservers", "dns.additional": "Additional records", "dns.qry": "Query", "dns.resp": "Resource record", "dns.resp.ttl": "Time to live", "dns.resp.len": "Data length", "dns.a": "Address", "dns.aaaa": "AAAA Address", "dns.ns": "Name Server",
    "dhcp": "Dynamic Host Configuration Protocol", "http": "Hypertext Transfer Protocol", "http.response.code": "Status Code", "http.content_type": "Content-Type", "http.content_length": "Content-Length", "http.transfer_encoding": "Transfer-Encoding", "tls": "Transport Layer Security",
}
#: words of names as labels write them; fixed values
WORDS = {"ip": "IP", "id": "ID", "dhcp": "DHCP", "ntp": "NTP", "alpn": "ALPN", "mac": "MAC", "ttl": "TTL", "str": "String", "len": "Length", "comp": "Compression", "ciphersuite": "Cipher Suite", "ciphersuites": "Cipher Suites", "desc": "Description", "hostname": "Host Name", "app": "Application", "max": "Maximum"}
#: protocols and groups whose fields' labels are written with capitals throughout
_TITLES = ("dhcp.option.", "http.", "tls.", "dns.soa.", "dns.ptr.", "dns.mx.")


def label(field: str) -> str:
    """A field's label: stated for it or for the last part of its name, else the words of that part."""
    if field in OWN:
        return OWN[field]
    last = field.rsplit(".", 1)[-1]
    if last in LAST:
        return LAST[last]
    words = [WORDS.get(w, w) for w in last.removeprefix("extensions_").split("_")]
    return " ".join(w[:1].upper() + w[1:] if not i or field.startswith(_TITLES) else w for i, w in enumerate(words))
