"""Station and event metadata: StationXML, QuakeML, RESP, SACPZ and dataless volumes."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape

from tremolite.sources.formats import _when, doy_us, iso_us

FAR_FUTURE = "2599-12-31T23:59:59"


def _strip(e: ET.Element) -> ET.Element:
    for n in e.iter():
        n.tag = n.tag.rsplit("}", 1)[-1]
    return e


def _f(e: ET.Element | None, path: str, default: float | None = None) -> float | None:
    t = None if e is None else e.findtext(path)
    return default if t in (None, "") else float(t)


def _overlaps(e: ET.Element, s: int | None, t: int | None) -> bool:
    a, z = iso_us(e.get("startDate") or "1970-01-01T00:00:00"), iso_us(e.get("endDate") or FAR_FUTURE)
    return (t is None or a <= t) and (s is None or z >= s)


def sxml_read(text: str, start_us: int | None = None, end_us: int | None = None) -> list[dict]:
    """StationXML channels whose network, station and channel epochs overlap the window: one dict per channel epoch.

    resp: a0, f0, p, z of the first poles-and-zeros stage; stages: gain, rate, delay and correction of every stage.
    """
    out = []
    for net in _strip(ET.fromstring(text)).iter("Network"):
        if not _overlaps(net, start_us, end_us):
            continue
        for sta in net.findall("Station"):
            if not _overlaps(sta, start_us, end_us):
                continue
            for cha in sta.findall("Channel"):
                if not _overlaps(cha, start_us, end_us):
                    continue
                pz, stages = None, []
                for s in cha.findall("Response/Stage"):
                    q = s.find("PolesZeros")
                    if q is not None and pz is None:
                        pz = q
                    stages.append({"stage": int(s.get("number", "0")), "gain": _f(s, "StageGain/Value", 1.0), "fg": _f(s, "StageGain/Frequency", 0.0), "fs": _f(s, "Decimation/InputSampleRate", 0.0), "fac": int(_f(s, "Decimation/Factor", 0) or 0), "os": int(_f(s, "Decimation/Offset", 0) or 0), "delay": _f(s, "Decimation/Delay", 0.0), "corr": _f(s, "Decimation/Correction", 0.0)})
                zp = lambda tag: [] if pz is None else [{"re": _f(e, "Real", 0.0), "im": _f(e, "Imaginary", 0.0)} for e in pz.findall(tag)]  # noqa: E731,B023
                out.append({
                    "id": f"{net.get('code')}.{sta.get('code')}.{(cha.get('locationCode') or '').strip()}.{cha.get('code')}",
                    "name": sta.findtext("Site/Name") or "", "start_us": iso_us(cha.get("startDate") or "1970-01-01T00:00:00"), "end_us": iso_us(cha.get("endDate") or FAR_FUTURE),
                    "lat": _f(cha, "Latitude", _f(sta, "Latitude")), "lon": _f(cha, "Longitude", _f(sta, "Longitude")), "el": _f(cha, "Elevation", _f(sta, "Elevation")), "dep": _f(cha, "Depth", 0.0),
                    "az": _f(cha, "Azimuth", 0.0), "inc": (_f(cha, "Dip", -90.0) or 0.0) + 90, "fs": _f(cha, "SampleRate", 0.0), "gain": _f(cha, "Response/InstrumentSensitivity/Value", 1.0),
                    "units": cha.findtext("Response/InstrumentSensitivity/InputUnits/Name") or "", "f0": _f(pz, "NormalizationFrequency", 1.0), "a0": _f(pz, "NormalizationFactor", 1.0), "p": zp("Pole"), "z": zp("Zero"), "stages": stages,
                })
    return out


def sxml_write(channels: list[dict]) -> str:
    """Channels of ``sxml_read``'s shape as StationXML, grouped by network and station."""
    tree: dict[str, dict[str, list[dict]]] = {}
    for c in channels:
        net, sta, _, _ = c["id"].split(".")
        tree.setdefault(net, {}).setdefault(sta, []).append(c)
    iso = lambda us: _when(us).strftime("%Y-%m-%dT%H:%M:%S") if us < iso_us(FAR_FUTURE) else FAR_FUTURE
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<FDSNStationXML xmlns="http://www.fdsn.org/xml/station/1" schemaVersion="1.1">', "<Source>tremolite</Source>", "<Created>1970-01-01T00:00:00</Created>"]
    for net, stas in sorted(tree.items()):
        out.append(f'<Network code="{escape(net)}">')
        for sta, cs in sorted(stas.items()):
            c0 = cs[0]
            out.append(f'<Station code="{escape(sta)}"><Latitude>{c0["lat"]!r}</Latitude><Longitude>{c0["lon"]!r}</Longitude><Elevation>{c0["el"]!r}</Elevation><Site><Name>{escape(c0["name"])}</Name></Site>')
            for c in cs:
                _, _, loc, cha = c["id"].split(".")
                row = lambda tag, q: f'<{tag}><Real>{q["re"]!r}</Real><Imaginary>{q["im"]!r}</Imaginary></{tag}>'
                pz = f'<PolesZeros><PzTransferFunctionType>LAPLACE (RADIANS/SECOND)</PzTransferFunctionType><NormalizationFactor>{c["a0"]!r}</NormalizationFactor><NormalizationFrequency>{c["f0"]!r}</NormalizationFrequency>' + "".join(row("Zero", q) for q in c["z"]) + "".join(row("Pole", q) for q in c["p"]) + "</PolesZeros>"
                stages = c.get("stages") or [{"stage": 1, "gain": c["gain"], "fg": c["f0"], "fs": 0.0, "fac": 0, "os": 0, "delay": 0.0, "corr": 0.0}]
                body = ""
                for k, s in enumerate(stages):
                    dec = f'<Decimation><InputSampleRate>{s["fs"]!r}</InputSampleRate><Factor>{s["fac"]}</Factor><Offset>{s["os"]}</Offset><Delay>{s["delay"]!r}</Delay><Correction>{s["corr"]!r}</Correction></Decimation>' if s["fs"] else ""
                    body += f'<Stage number="{s["stage"]}">{pz if k == 0 else ""}{dec}<StageGain><Value>{s["gain"]!r}</Value><Frequency>{s["fg"]!r}</Frequency></StageGain></Stage>'
                out.append(f'<Channel code="{escape(cha)}" locationCode="{escape(loc)}" startDate="{iso(c["start_us"])}" endDate="{iso(c["end_us"])}"><Latitude>{c["lat"]!r}</Latitude><Longitude>{c["lon"]!r}</Longitude><Elevation>{c["el"]!r}</Elevation><Depth>{c["dep"]!r}</Depth><Azimuth>{c["az"]!r}</Azimuth><Dip>{c["inc"] - 90!r}</Dip><SampleRate>{c["fs"]!r}</SampleRate><Response><InstrumentSensitivity><Value>{c["gain"]!r}</Value><Frequency>{c["f0"]!r}</Frequency><InputUnits><Name>{escape(c["units"])}</Name></InputUnits></InstrumentSensitivity>{body}</Response></Channel>')
            out.append("</Station>")
        out.append("</Network>")
    return "\n".join(out + ["</FDSNStationXML>"])


def qml_read(text: str) -> list[dict]:
    """QuakeML events: preferred origin, magnitude and mechanism (else the first), and their picks by arrival."""
    out = []
    for ev in _strip(ET.fromstring(text)).iter("event"):
        def pick(tag: str, pref: str):
            want, all_ = (ev.findtext(pref) or "").strip(), ev.findall(tag)  # noqa: B023
            return next((e for e in all_ if e.get("publicID") == want), all_[0] if all_ else None)

        o, m, fm = pick("origin", "preferredOriginID"), pick("magnitude", "preferredMagnitudeID"), pick("focalMechanism", "preferredFocalMechanismID")
        picks = {p.get("publicID"): p for p in ev.findall("pick")}
        arr = []
        for a in o.findall("arrival") if o is not None else []:
            p = picks.get((a.findtext("pickID") or "").strip())
            w = None if p is None else p.find("waveformID")
            arr.append({"id": "" if w is None else f"{w.get('networkCode', '')}.{w.get('stationCode', '')}.{w.get('locationCode', '')}.{w.get('channelCode', '')}", "phase": a.findtext("phase") or "", "us": None if p is None else iso_us(p.findtext("time/value")), "d": _f(a, "distance", 0.0), "res": _f(a, "timeResidual", 0.0), "ta": _f(a, "takeoffAngle/value", 0.0)})
        mt = None if fm is None else fm.find("momentTensor")
        out.append({
            "event_id": re.sub(r"^.*[/=]", "", ev.get("publicID") or ""), "typ": ev.findtext("type") or "", "name": ev.findtext("description/text") or "",
            "ot_us": None if o is None else iso_us(o.findtext("time/value")), "lat": _f(o, "latitude/value"), "lon": _f(o, "longitude/value"), "dep": None if o is None or _f(o, "depth/value") is None else _f(o, "depth/value") / 1000,
            "nst": int(_f(o, "quality/usedStationCount", 0) or 0), "gap": _f(o, "quality/azimuthalGap", 0.0), "rms": _f(o, "quality/standardError", 0.0), "mag": _f(m, "mag/value", -5.0), "mag_scale": "" if m is None else m.findtext("type") or "",
            "m0": _f(mt, "scalarMoment/value"), "mt": [] if mt is None else [_f(mt, f"tensor/{k}/value", 0.0) for k in ("Mrr", "Mtt", "Mpp", "Mrt", "Mrp", "Mtp")], "picks": arr,
        })
    return out


def qml_write(events: list[dict]) -> str:
    """Events of ``qml_read``'s shape as QuakeML."""
    iso = lambda us: _when(us).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<q:quakeml xmlns="http://quakeml.org/xmlns/bed/1.2" xmlns:q="http://quakeml.org/xmlns/quakeml/1.2"><eventParameters publicID="smi:local/catalog">']
    for e in events:
        k, v = escape(e["event_id"]), lambda tag, x: f"<{tag}><value>{x!r}</value></{tag}>"
        out.append(f'<event publicID="smi:local/event/{k}"><preferredOriginID>smi:local/origin/{k}</preferredOriginID><preferredMagnitudeID>smi:local/mag/{k}</preferredMagnitudeID><type>{escape(e["typ"])}</type><description><text>{escape(e["name"])}</text></description>')
        arr = ""
        for j, p in enumerate(e.get("picks", [])):
            net, sta, loc, cha = p["id"].split(".")
            out.append(f'<pick publicID="smi:local/pick/{k}/{j}"><time><value>{iso(p["us"])}</value></time><waveformID networkCode="{net}" stationCode="{sta}" locationCode="{loc}" channelCode="{cha}"/></pick>')
            arr += f'<arrival publicID="smi:local/arrival/{k}/{j}"><pickID>smi:local/pick/{k}/{j}</pickID><phase>{escape(p["phase"])}</phase><distance>{p["d"]!r}</distance><timeResidual>{p["res"]!r}</timeResidual></arrival>'
        out.append(f'<origin publicID="smi:local/origin/{k}"><time><value>{iso(e["ot_us"])}</value></time>{v("latitude", e["lat"])}{v("longitude", e["lon"])}{v("depth", e["dep"] * 1000)}<quality><usedStationCount>{e["nst"]}</usedStationCount><azimuthalGap>{e["gap"]!r}</azimuthalGap><standardError>{e["rms"]!r}</standardError></quality>{arr}</origin>')
        out.append(f'<magnitude publicID="smi:local/mag/{k}">{v("mag", e["mag"])}<type>{escape(e["mag_scale"])}</type></magnitude></event>')
    return "\n".join(out + ["</eventParameters></q:quakeml>"])


def sacpz_read(text: str) -> list[dict]:
    """SACPZ: '*' header lines, then ZEROS, POLES, CONSTANT; one dict per response."""
    out, h, cur = [], {}, None
    for line in text.splitlines():
        s = line.strip()
        if s.startswith("*"):
            if cur and "a0" in cur:
                out.append(cur)
                h, cur = {}, None
            m = re.match(r"\*\s*([A-Z][A-Z ]*?)\s*(?:\(\w+\))?\s*:\s*(.*)$", s)
            if m:
                h[m[1]] = m[2].strip()
        elif s:
            w = s.split()
            if cur is None or (w[0] == "ZEROS" and "a0" in cur):
                if cur:
                    out.append(cur)
                num = lambda k, d=0.0: float(re.split(r"[ (]", h[k])[0]) if h.get(k) else d  # noqa: E731,B023
                cur = {"id": ".".join(h.get(k, "") for k in ("NETWORK", "STATION", "LOCATION", "CHANNEL")), "name": h.get("DESCRIPTION", ""), "start_us": iso_us(h["START"]) if h.get("START") else 0, "end_us": iso_us(h["END"]) if h.get("END") else iso_us(FAR_FUTURE), "lat": num("LATITUDE"), "lon": num("LONGITUDE"), "el": num("ELEVATION"), "dep": num("DEPTH"), "inc": num("DIP"), "az": num("AZIMUTH"), "fs": num("SAMPLE RATE"), "gain": num("SENSITIVITY", 1.0), "units": h.get("INPUT UNIT", "").lower(), "p": [], "z": []}
                into, want = None, 0
            if w[0] in ("ZEROS", "POLES"):
                into, want = cur["z" if w[0] == "ZEROS" else "p"], int(w[1])
                into.extend({"re": 0.0, "im": 0.0} for _ in range(want))
                at = 0
            elif w[0] == "CONSTANT":
                cur["a0"] = float(w[1])
            elif into is not None and at < want:
                into[at] = {"re": float(w[0]), "im": float(w[1])}
                at += 1
    if cur:
        out.append(cur)
    return out


def sacpz_write(channels: list[dict]) -> str:
    out = []
    for c in channels:
        net, sta, loc, cha = c["id"].split(".")
        rows = [("NETWORK", net), ("STATION", sta), ("LOCATION", loc), ("CHANNEL", cha), ("START", _when(c["start_us"]).strftime("%Y-%m-%dT%H:%M:%S")), ("END", _when(c["end_us"]).strftime("%Y-%m-%dT%H:%M:%S")), ("DESCRIPTION", c["name"]), ("LATITUDE", repr(c["lat"])), ("LONGITUDE", repr(c["lon"])), ("ELEVATION", repr(c["el"])), ("DEPTH", repr(c["dep"])), ("DIP", repr(c["inc"])), ("AZIMUTH", repr(c["az"])), ("SAMPLE RATE", repr(c["fs"])), ("INPUT UNIT", c["units"].upper()), ("SENSITIVITY", repr(c["gain"]))]
        out += [f"* {k:<16}: {v}" for k, v in rows]
        for tag, k in (("ZEROS", "z"), ("POLES", "p")):
            out += [f"{tag}\t{len(c[k])}"] + [f"\t{q['re']!r}\t{q['im']!r}" for q in c[k]]
        out.append(f"CONSTANT\t{c['a0']!r}")
    return "\n".join(out) + "\n"


def _time(s: str) -> int:
    """'YYYY,JJJ,HH:MM:SS.ffff' to microseconds; 'No Ending Time' is far in the future."""
    m = re.match(r"(\d{4}),(\d{1,3})(?:,(\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?)?", s.strip())
    if not m:
        return iso_us(FAR_FUTURE)
    return doy_us(int(m[1]), int(m[2]), int(m[3] or 0), int(m[4] or 0), int(m[5] or 0), int((m[6] or "0")[:6].ljust(6, "0")))


def resp_read(text: str) -> list[dict]:
    """RESP text: one dict per channel epoch with all stages (blockettes 53, 54, 57, 58 by field)."""
    out, cur, stage = [], None, None
    for line in text.splitlines():
        m = re.match(r"B(\d{3})F(\d{2})(?:-(\d{2}))?\s+(.*)$", line)
        if not m:
            continue
        b, f, body = int(m[1]), int(m[2]), m[4]
        v = body.split(":", 1)[1].strip() if ":" in body else ""
        if (b, f) == (50, 3):
            cur = {"station": v, "p": [], "z": [], "a0": 1.0, "f0": 1.0, "gain": 1.0, "units": "", "stages": {}}
            out.append(cur)
        if cur is None:
            continue
        st = lambda k: cur["stages"].setdefault(k, {"stage": k, "gain": 1.0, "fg": 0.0, "fs": 0.0, "fac": 0, "os": 0, "delay": 0.0, "corr": 0.0, "b": [], "a": []})  # noqa: E731,B023
        num = lambda s: float(s.split()[0]) if s.split() else 0.0
        if (b, f) == (50, 16):
            cur["network"] = v
        elif (b, f) == (52, 3):
            cur["location"] = "" if v in ("??", "--") else v
        elif (b, f) == (52, 4):
            cur["channel"] = v
        elif (b, f) == (52, 22):
            cur["start_us"] = _time(v)
        elif (b, f) == (52, 23):
            cur["end_us"] = _time(v)
        elif b in (53, 54) and f == 4 or b in (57, 58) and f == 3:
            stage = int(num(v))
        elif b == 53:
            if f == 5 and not cur["units"]:
                cur["units"] = v.split(" - ")[0].strip()
            elif f == 7 and not cur["p"]:
                cur["a0"] = num(v)
            elif f == 8 and not cur["p"]:
                cur["f0"] = num(v)
            elif f in (10, 15):
                w = body.split()
                (cur["z"] if f == 10 else cur["p"]).append({"re": float(w[1]), "im": float(w[2])})
        elif b == 54 and f in (8, 11) and stage:
            st(stage)["b" if f == 8 else "a"].append(float(body.split()[1]))
        elif b == 57 and stage:
            key = {4: "fs", 5: "fac", 6: "os", 7: "delay", 8: "corr"}.get(f)
            if key:
                st(stage)[key] = int(num(v)) if key in ("fac", "os") else num(v)
        elif b == 58:
            if f == 4 and stage == 0:
                cur["gain"] = num(v)
            elif f in (4, 5) and stage:
                st(stage)["gain" if f == 4 else "fg"] = num(v)
    for c in out:
        c["id"] = ".".join(c.get(k, "") for k in ("network", "station", "location", "channel"))
        c["stages"] = [c["stages"][k] for k in sorted(c["stages"])]
    return out


def dataless_read(data: bytes, size: int = 4096) -> list[dict]:
    """Dataless volumes: blockettes of station records in sequence; stations (50), channels (52), poles and zeros (53), sensitivities (58), decimation (57)."""
    body = b"".join(data[k + 8 : k + size] for k in range(0, len(data), size) if data[k + 6 : k + 7] in (b"S", b"A"))
    text, at, out, sta, cur = body.decode("latin-1"), 0, [], {}, None
    units: dict[int, str] = {}
    while at + 7 <= len(text):
        head = text[at : at + 7]
        if not head.isdigit():
            at += 1
            continue
        kind, n = int(head[:3]), int(head[3:])
        if n < 7:
            at += 1
            continue
        b, o = text[at : at + n], 7
        at += n

        def take(k: int) -> str:
            nonlocal o
            o += k
            return b[o - k : o].strip()  # noqa: B023

        def var() -> str:
            nonlocal o
            z = b.find("~", o)  # noqa: B023
            z = len(b) if z < 0 else z  # noqa: B023
            s, o = b[o:z], z + 1  # noqa: B023
            return s.strip()

        if kind == 34:
            k = int(take(3))
            units[k] = var()
        elif kind == 50:
            sta = {"station": take(5), "lat": float(take(10)), "lon": float(take(11)), "el": float(take(7))}
            take(4), take(3)
            sta["name"] = var()
            take(3), take(4), take(2)
            sta["start"], sta["end"], _, sta["network"] = var(), var(), take(1), take(2)
        elif kind == 52:
            loc, cha = take(2), take(3)
            take(4), take(3)
            var()
            u = take(3)
            take(3)
            lat, lon, el, dep, az, dip = float(take(10)), float(take(11)), float(take(7)), float(take(5)), float(take(5)), float(take(5))
            take(4), take(2)
            fs = float(take(10))
            take(10), take(4)
            var()
            cur = {"id": f"{sta.get('network', '')}.{sta.get('station', '')}.{loc}.{cha}", "name": sta.get("name", ""), "units": units.get(int(u or 0), ""), "lat": lat, "lon": lon, "el": el, "dep": dep, "az": az, "inc": dip + 90, "fs": fs, "gain": 1.0, "a0": 1.0, "f0": 1.0, "p": [], "z": [], "start_us": _time(var()), "end_us": _time(var())}
            out.append(cur)
        elif kind == 53 and cur is not None:
            take(1), take(2), take(3), take(3)
            a0, f0 = float(take(12)), float(take(12))
            zs = [(float(take(12)), float(take(12)), take(12), take(12)) for _ in range(int(take(3)))]
            ps = [(float(take(12)), float(take(12)), take(12), take(12)) for _ in range(int(take(3)))]
            if not cur["p"]:
                cur |= {"a0": a0, "f0": f0, "z": [{"re": q[0], "im": q[1]} for q in zs], "p": [{"re": q[0], "im": q[1]} for q in ps]}
        elif kind == 58 and cur is not None:
            k, g = int(take(2)), float(take(12))
            if k == 0:
                cur["gain"] = g
    return out


def dataless_write(channels: list[dict], size: int = 4096) -> bytes:
    """Minimal dataless volume of channels (blockettes 34, 50, 52, 53, 58)."""
    def blk(kind: int, body: str) -> str:
        return f"{kind:03d}{len(body) + 7:04d}{body}"

    t = lambda us: _when(us).strftime("%Y,%j,%H:%M:%S") + "~"
    names = sorted({c["units"] for c in channels})
    s = "".join(blk(34, f"{k + 1:03d}{u}~~") for k, u in enumerate(names))
    for c in channels:
        net, sta, loc, cha = c["id"].split(".")
        s += blk(50, f"{sta:<5}{c['lat']:+010.6f}{c['lon']:+011.6f}{c['el']:+07.1f}0001000{c['name']}~001321010" + t(c["start_us"]) + t(c["end_us"]) + f"N{net:<2}")
        s += blk(52, f"{loc:<2}{cha:<3}0000000~{names.index(c['units']) + 1:03d}000{c['lat']:+010.6f}{c['lon']:+011.6f}{c['el']:+07.1f}{c['dep']:05.1f}{c['az']:05.1f}{c['inc'] - 90:+05.1f}000010{c['fs']:10.4E}{0:10.4E}0000CG~" + t(c["start_us"]) + t(c["end_us"]) + "N")
        zp = lambda qs: f"{len(qs):3d}" + "".join(f"{q['re']:+12.5E}{q['im']:+12.5E}{0:+12.5E}{0:+12.5E}" for q in qs)
        s += blk(53, f"A01001002{c['a0']:+12.5E}{c['f0']:+12.5E}{zp(c['z'])}{zp(c['p'])}")
        s += blk(58, f"00{c['gain']:+12.5E}{1:+12.5E}00")
    raw, out = s.encode("latin-1"), []
    for k in range(0, len(raw), size - 8):
        out.append((f"{k // (size - 8) + 1:06d}S{' ' if k == 0 else '*'}".encode() + raw[k : k + size - 8]).ljust(size, b" "))
    return b"".join(out)


META_READERS = {"sxml": sxml_read, "sacpz": sacpz_read, "resp": resp_read, "qml": qml_read}
