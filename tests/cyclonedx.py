"""The rules of CycloneDX 1.6 that a cryptographic bill of materials has to keep: required fields, types, enumerations and references."""

import re

#: Enumerations of the specification. Fixed values.
PRIMITIVES = "drbg mac block-cipher stream-cipher signature hash pke xof kdf key-agree kem ae combiner other unknown".split()
MODES = "cbc ecb ccm gcm cfb ofb ctr other unknown".split()
PADDINGS = "pkcs5 pkcs7 pkcs1v15 oaep raw other unknown".split()
FUNCTIONS = "generate keygen encrypt decrypt digest tag keyderive sign verify encapsulate decapsulate other unknown".split()
ENVIRONMENTS = "software-plain-ram software-encrypted-ram software-tee hardware other unknown".split()
PLATFORMS = "generic x86_32 x86_64 armv7-a armv7-m armv8-a armv8-m armv9-a armv9-m s390x ppc64 ppc64le other unknown".split()
ALGORITHM = {"primitive", "parameterSetIdentifier", "curve", "executionEnvironment", "implementationPlatform", "certificationLevel", "mode", "padding", "cryptoFunctions", "classicalSecurityLevel", "nistQuantumSecurityLevel"}
COMPONENT = {"type", "bom-ref", "name", "version", "description", "purl", "cryptoProperties", "evidence", "properties"}


def problems(bom: dict) -> list[str]:
    """What a document does against the rules, if anything."""
    out: list[str] = []

    def need(test: object, what: str) -> None:
        if not test:
            out.append(what)

    need(bom.get("bomFormat") == "CycloneDX" and bom.get("specVersion") == "1.6" and isinstance(bom.get("version"), int) and bom["version"] >= 1, "head")
    need(re.fullmatch(r"urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", bom.get("serialNumber", "")), "serialNumber")
    need(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z", bom["metadata"]["timestamp"]), "timestamp")
    every = [*bom["components"], bom["metadata"]["component"], *bom["metadata"]["tools"]["components"]]
    refs = [c.get("bom-ref") for c in every]
    need(len(refs) == len(set(refs)) and all(isinstance(r, str) and r for r in refs), "bom-ref")
    for c in every:
        at = c.get("bom-ref")
        need(c.get("type") in ("library", "application", "cryptographic-asset") and isinstance(c.get("name"), str) and c["name"], f"{at}: type, name")
        need(set(c) <= COMPONENT or c["type"] == "application", f"{at}: {set(c) - COMPONENT}")
        need((c["type"] == "cryptographic-asset") == ("cryptoProperties" in c), f"{at}: cryptoProperties")
        need("purl" not in c or re.fullmatch(r"pkg:npm/(%40[^/@]+/)?[^/@]+(@[^@]+)?", c["purl"]), f"{at}: purl")
        need(all(set(p) == {"name", "value"} and isinstance(p["name"], str) and isinstance(p["value"], str) for p in c.get("properties", [])), f"{at}: properties")
        for o in c.get("evidence", {}).get("occurrences", []):
            need(isinstance(o.get("location"), str) and o["location"] and all(isinstance(o.get(k, 0), int) and o.get(k, 0) >= 0 for k in ("line", "offset")) and all(isinstance(o.get(k, ""), str) for k in ("symbol", "additionalContext")) and set(o) <= {"bom-ref", "location", "line", "offset", "symbol", "additionalContext"}, f"{at}: {o}")
        crypto = c.get("cryptoProperties", {})
        if crypto.get("assetType") == "algorithm":
            a = crypto["algorithmProperties"]
            need(set(a) <= ALGORITHM, f"{at}: {set(a) - ALGORITHM}")
            for key, allowed in (("primitive", PRIMITIVES), ("mode", MODES), ("padding", PADDINGS), ("executionEnvironment", ENVIRONMENTS), ("implementationPlatform", PLATFORMS)):
                need(key not in a or a[key] in allowed, f"{at}: {key} {a.get(key)}")
            need(a.get("cryptoFunctions") and set(a["cryptoFunctions"]) <= set(FUNCTIONS) and len(set(a["cryptoFunctions"])) == len(a["cryptoFunctions"]), f"{at}: cryptoFunctions")
            need(isinstance(a.get("classicalSecurityLevel", 0), int) and a.get("classicalSecurityLevel", 0) >= 0 and a.get("nistQuantumSecurityLevel", 0) in range(7), f"{at}: levels")
            need(all(isinstance(a.get(k, ""), str) for k in ("parameterSetIdentifier", "curve")), f"{at}: names")
        elif "cryptoProperties" in c:
            p = crypto.get("protocolProperties", {})
            need(crypto.get("assetType") == "protocol" and p.get("type") == "tls" and isinstance(p.get("version", ""), str), f"{at}: protocol")
            need(set(p.get("cryptoRefArray", [])) <= set(refs), f"{at}: cryptoRefArray")
    owners = [d["ref"] for d in bom["dependencies"]]
    need(len(owners) == len(set(owners)) and set(owners) <= set(refs), "dependencies")
    for d in bom["dependencies"]:
        for key in ("dependsOn", "provides"):
            need(set(d.get(key, [])) <= set(refs) and len(set(d.get(key, []))) == len(d.get(key, [])), f"{d['ref']}: {key}")
        need(set(d) <= {"ref", "dependsOn", "provides"}, f"{d['ref']}: fields")
    return out
