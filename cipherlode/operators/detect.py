"""Detectors: uses of cryptography among the lexical facts, each a projection over joins."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cipherlode import dims
from cipherlode.functions import code as C
from cipherlode.functions import names as N
from cipherlode.functions import words as V
from cipherlode.operators import lexical, scopes
from cipherlode.store import large, settle

FOUND = ["path", "line", "col", "detector", "ord", "part", "interface", "operation", "spec", "extra", "evidence"]


def _codes(*pairs: tuple[Column, str]) -> Column:
    """Codes whose test holds."""
    if not pairs:
        return F.array().cast("array<string>")
    return F.filter(F.array(*(F.when(test, code) for test, code in pairs)), lambda c: c.isNotNull())


def _arg(i: int) -> Column:
    """Argument i of a call as a value, or null."""
    return F.try_element_at("args", F.lit(i + 1))


def _text(i: int) -> Column:
    return _arg(i)["text"]


def _number(i: int) -> Column:
    return _arg(i)["number"]


def _field(value: Column, key: str) -> Column:
    """What an object sets a field to, a value; null where it is no object or has no such field. An object in it has fields of its own, as key.inner."""
    return F.try_element_at(value["fields"], F.lit(key))


def _held(i: int, what: str) -> Column:
    """The use of a value that isn't written at the call."""
    v = _arg(i)
    return N.dynamic(F.when((v["given"] != "") & v["kind"].isin("name", "other"), F.concat(F.lit(f"{what} held in "), v["given"])).otherwise(F.lit(f"{what} not written here")))


def _result(rows: DataFrame, detector: int, interface: Column | str, spec: Column, extra: Column | None = None, part: int = 0) -> DataFrame:
    """Findings of rows with an operation; part tells findings of one call apart."""
    face = F.lit(interface) if isinstance(interface, str) else interface
    place = F.col("part") if "part" in rows.columns else F.lit(part)
    out = rows.select("path", "line", "col", F.lit(detector).alias("detector"), "ord", place.alias("part"), face.alias("interface"), "operation", C.once(C.aside(spec)).alias("spec"), (extra if extra is not None else _codes()).alias("extra"), "evidence")
    return out.where("spec IS NOT NULL")


def web_crypto(calls: DataFrame) -> DataFrame:
    """SubtleCrypto methods, a finding for each algorithm argument, and the global random functions."""
    method, size = F.element_at("chain", -1), F.size("chain")
    said = lambda c: F.coalesce(c.rlike("(?i)crypto"), F.lit(False))
    on = lambda k: F.when(size > k, said(F.try_element_at("chain", F.lit(-1 - k)))).otherwise(F.when(F.size("members") == size, said(F.col("module"))).otherwise(F.col("crypto_root")))
    in_node = (F.col("module") == "crypto") & (F.try_element_at("members", F.lit(-2)) == "subtle")
    random = calls.where(method.isin("getRandomValues", "randomUUID") & on(1) & ~F.coalesce(F.col("module") == "crypto", F.lit(False))).withColumn("operation", method)

    subtle = F.coalesce(F.try_element_at("chain", F.lit(-2)) == "subtle", F.lit(False))
    named = (subtle & F.when(size > 2, on(2)).otherwise(F.when(F.size("members") == size, said(F.col("module"))).otherwise(F.col("crypto_root")))) | F.col("alias") | ((size == 2) & F.coalesce(in_node, F.lit(False)))
    places = F.create_map(*(x for m, at in dims.SUBTLE.items() for x in (F.lit(m), F.array(*map(F.lit, at)))))
    used = calls.where(method.isin(*dims.SUBTLE)).where(named).withColumn("operation", method)
    each = used.withColumn("part", F.explode(F.element_at(places, F.col("operation")))).withColumn("v", F.try_element_at("args", F.col("part") + 1))
    # a finding's place is its argument's own
    each = each.withColumns({c: F.when(F.col("v").isNotNull(), F.col("v")[c]).otherwise(F.col(c)) for c in ("line", "col", "evidence")})
    v = F.col("v")
    text = lambda k: F.coalesce(_field(v, k)["text"], _field(v, f"{k}.name")["text"])
    texts, numbers = ("namedCurve", "hash"), ("length", "modulusLength", "iterations")
    each = each.withColumns({f"s_{k}": text(k) for k in ("name", *texts)} | {f"n_{k}": _field(v, k)["number"] for k in numbers})
    spec = (
        F.when(v.isNull(), N.dynamic(F.concat("operation", F.lit(": no algorithm argument"))))
        .when(v["kind"] == "string", N.webcrypto(v["text"]))
        .when((v["kind"] == "object") & F.col("s_name").isNotNull(), N.webcrypto(F.col("s_name"), F.col("s_namedCurve"), F.col("s_hash"), F.col("n_length"), F.col("n_modulusLength"), F.col("n_iterations")))
        .when(v["kind"] == "object", N.dynamic(F.concat(F.lit("algorithm name held in "), F.coalesce(F.nullif(_field(v, "name")["code"], F.lit("")), F.lit("an expression")))))
        .otherwise(N.dynamic(F.concat(F.lit("algorithm held in "), F.coalesce(F.nullif(v["code"], F.lit("")), F.lit("an expression")))))
    )
    unread = F.lit(False)
    for k in (*texts, *numbers):
        unread = unread | (_field(v, k).isNotNull() & F.col(f"{'s' if k in texts else 'n'}_{k}").isNull())
    return _result(random, 0, "web-crypto", N.spec("CSPRNG")).unionByName(_result(each, 0, "web-crypto", spec, _codes((F.col("s_name").isNotNull() & unread, "parameter-not-literal"))))


def node_crypto(calls: DataFrame) -> DataFrame:
    """Calls bound to node:crypto, by method and literal arguments."""
    path = F.when(F.try_element_at("members", F.lit(1)) == "webcrypto", F.slice("members", 2, 100)).otherwise(F.col("members"))
    used = calls.where((F.col("module") == "crypto") & ~F.array_contains("members", "subtle")).withColumn("operation", F.array_join(path, ".")).where("operation <> ''")
    m = F.col("operation")
    options = lambda i, *keys: F.coalesce(*(_field(_arg(i), k)["number"] for k in keys))
    jwk = lambda k: F.coalesce(_field(_arg(0), f"key.{k}")["text"], _field(_arg(0), k)["text"])
    used = used.withColumns({"t0": _text(0), "modulus": options(1, "modulusLength"), "curve": _field(_arg(1), "namedCurve")["text"], "prime": options(1, "primeLength"), "modp": _field(_arg(1), "group")["text"], "length": options(1, "length"), "cost": options(3, "N", "cost")})
    used = used.withColumns({"kty": jwk("kty"), "crv": jwk("crv"), "h0": N.normalise_hash(F.col("t0")), "h4": F.coalesce(N.normalise_hash(_text(4)), _text(4))})
    t0, h0 = F.col("t0"), F.col("h0")
    counted = lambda key, n: F.map_filter(F.create_map(F.lit(key), n.cast("string")), lambda _, v: v.isNotNull())
    iterations = _number(2)
    spec = (
        F.when(m.isin(*dims.RANDOM_METHODS), N.spec("CSPRNG"))
        .when(m.isin("createHash", "hash"), F.when(t0.isNull(), _held(0, "hash")).when(h0.isNotNull(), N.spec("Hash", hash=h0)).otherwise(N.unknown_literal(t0)))
        .when(m == "createHmac", F.when(t0.isNull(), _held(0, "HMAC hash")).otherwise(N.spec("HMAC", hash=F.coalesce(h0, t0))))
        .when(m.isin("createCipheriv", "createDecipheriv", "createCipher", "createDecipher"), F.when(t0.isNull(), _held(0, "cipher")).otherwise(N.cipher(t0)))
        .when(m.isin("generateKeyPair", "generateKeyPairSync"), F.when(t0.isNull(), _held(0, "key type")).otherwise(N.key_type(t0, F.col("modulus"), F.col("curve"), F.col("prime"), F.col("modp"))))
        .when(m.isin("generateKey", "generateKeySync"), F.when(t0 == "aes", N.spec("AES", key_size=F.col("length"))).when(t0 == "hmac", N.spec("HMAC", key_size=F.col("length"))).when(t0.isNull(), _held(0, "key type")).otherwise(N.unknown_literal(t0)))
        .when(m.isin("sign", "verify") & (F.coalesce(_arg(0)["kind"], F.lit("null")) == "null"), N.dynamic(F.lit("signature algorithm set by the key")))
        .when(m.isin("createSign", "createVerify", "sign", "verify"), F.when(t0.isNull(), _held(0, "signature algorithm")).otherwise(N.signature(t0)))
        .when(m == "createECDH", N.spec("ECDH", curve=N.normalise_curve(t0)))
        .when(m == "createDiffieHellman", N.spec("DH", key_size=_number(0)))
        .when(m.isin("getDiffieHellman", "createDiffieHellmanGroup"), N.spec("DH", key_size=N.modp_bits(t0)))
        .when(m == "diffieHellman", N.spec("DH/ECDH", notes=["key-decides"]))
        .when(m.isin("publicEncrypt", "privateDecrypt"), F.when(F.col("padded"), N.spec("RSAES-PKCS1-v1_5")).otherwise(N.spec("RSA-OAEP")))
        .when(m.isin("privateEncrypt", "publicDecrypt"), N.spec("RSA raw signature"))
        .when(m.isin("pbkdf2", "pbkdf2Sync"), N.spec("PBKDF2", hash=F.col("h4"), parameters=counted("iterations", iterations)))
        .when(m.isin("scrypt", "scryptSync"), N.spec("scrypt", parameters=counted("N", F.col("cost"))))
        .when(m.isin("hkdf", "hkdfSync"), N.spec("HKDF", hash=F.coalesce(h0, t0)))
        .when(m.isin("createPublicKey", "createPrivateKey"), F.coalesce(N.jwk(F.col("kty"), F.col("crv")), N.dynamic(F.lit("key type set by the key material"))))
        .when(m == "KeyObject.from", N.dynamic(F.lit("key type set by the key")))
        .when(m == "X509Certificate", N.dynamic(F.lit("X.509 certificate: its algorithms are inside the certificate")))
        .when(m.isin("encapsulate", "decapsulate"), N.dynamic(F.lit("key encapsulation: the algorithm is set by the key")))
    )
    extra = _codes((m.isin("pbkdf2", "pbkdf2Sync") & iterations.isNull(), "parameter-not-literal"), ((m == "createECDH") & t0.isNull(), "parameter-not-literal"))
    return _result(used, 1, "node:crypto", spec, extra)


def parameters(constants: DataFrame) -> DataFrame:
    """Constants of the top level (as resolved gives them) that by their name are a PBKDF2 iteration count."""
    named = constants.where(F.col("name").rlike("(?i)pbkdf2") & F.col("name").rlike("(?i)iter|rounds") & F.col("value.number").isNotNull())
    return _result(named.withColumn("operation", F.lit("iteration count")), 2, "constant", N.spec("PBKDF2", parameters=F.create_map(F.lit("iterations"), F.col("value.number").cast("string")), notes=["declared-here"]))


def package_of(module: Column) -> Column:
    """struct<name, subpath> of a package specifier; null for relative, absolute and node: ones."""
    pattern = r"^(@[^/]+/[^/]+|[^/@][^/]*)(?:/(.*))?$"
    named = ~module.rlike(r"(?i)^(\.|/|node:|[a-z]:)") & module.rlike(pattern)
    return F.when(named, F.struct(F.regexp_extract(module, pattern, 1).alias("name"), F.regexp_replace(F.regexp_extract(module, pattern, 2), r"\.[cm]?js$", "").alias("subpath")))


def imported_packages(sites: DataFrame) -> DataFrame:
    """(path, package, subpath, line, col, ord, evidence) of imports of catalogued packages."""
    known = F.broadcast(dims.libraries(sites.sparkSession).select("package"))
    p = package_of(F.col("module"))
    return sites.select("path", p["name"].alias("package"), p["subpath"].alias("subpath"), "line", "col", "ord", "evidence").join(known, "package", "left_semi")


def longest_member(uses: DataFrame) -> DataFrame:
    """Uses (path, ord, package, subpath, key) with the catalogue's row: a subpath's own, else the longest member that key equals or goes on from at . or _; * fits anything."""
    table = dims.library_calls(uses.sparkSession)
    hit = (F.col("key") == F.col("member")) | F.col("key").startswith(F.concat("member", F.lit("."))) | F.col("key").startswith(F.concat("member", F.lit("_"))) | (F.col("member") == "*")
    fits = F.when(F.col("is_subpath"), (F.col("key") == "()") & (F.col("subpath") == F.col("member"))).otherwise(hit)
    joined = uses.join(F.broadcast(table), "package").where(fits)
    rank = W.Window.partitionBy("path", "ord").orderBy(F.desc("is_subpath"), F.col("member") == "*", F.desc(F.length("member")))
    return joined.withColumn("r", F.row_number().over(rank)).where("r = 1").drop("r")


def library_calls(calls: DataFrame) -> DataFrame:
    """Calls of catalogued packages, with the literal arguments that their rows name; also the second algorithm of a call that has two."""
    p = package_of(F.col("module"))
    uses = calls.where("module IS NOT NULL").withColumn("package", p["name"]).withColumn("subpath", p["subpath"]).withColumn("key", F.coalesce(F.nullif(F.array_join("members", "."), F.lit("")), F.lit("()")))
    found = longest_member(uses).withColumn("operation", F.col("key"))

    def at(column: str) -> Column:
        """The argument, or a field of it, whose place a catalogue's column names."""
        place, inner = F.element_at(F.split(column, r"\."), 1).cast("int"), F.try_element_at(F.split(column, r"\."), F.lit(2))
        arg = F.try_element_at("args", place + 1)
        value = lambda x: F.struct(x["text"].alias("text"), x["number"].alias("number"))
        return F.when(F.col(column).isNotNull(), F.when(inner.isNull(), value(arg)).otherwise(value(F.try_element_at(arg["fields"], inner))))

    found = found.withColumns({c: at(c) for c in ("key_type_at", "iterations_at", "curve_at", "size_at")} | {"cipher_": at("cipher_at")})
    noble = F.col("package") == "@noble/hashes"
    cost_at = F.when(F.col("family") == "bcrypt", F.when(F.col("member").startswith("hash"), _number(1)).when(F.col("member").startswith("genSalt"), _number(0)))
    rounds = F.when(noble & (F.col("family") == "PBKDF2"), _field(_arg(3), "c")["number"]).otherwise(F.col("iterations_at.number"))
    named_hash = F.when(noble & F.col("family").isin("HMAC", "HKDF", "PBKDF2") & (_arg(0)["kind"] == "name"), N.normalise_hash(_arg(0)["code"]))
    found = found.withColumns({"kind_": F.upper("key_type_at.text"), "cipher_": F.col("cipher_.text"), "rounds": rounds, "cost": cost_at, "hash": F.coalesce(named_hash, F.col("hash")), "curve_": N.normalise_curve(F.coalesce("curve_at.text", "curve")), "bits": F.coalesce("size_at.number", "bits")})
    params = F.map_filter(F.create_map(F.lit("cost"), F.col("cost").cast("string"), F.lit("iterations"), F.col("rounds").cast("string")), lambda _, v: v.isNotNull())
    notes = F.when(F.col("note").isNotNull(), F.array("note")).otherwise(F.array().cast("array<string>"))
    spec = (
        F.when(F.col("cipher_at").isNotNull(), F.coalesce(N.cipher(F.col("cipher_")), N.dynamic(F.lit("cipher name not written here"))))
        .when(F.col("key_type_at").isNotNull(), F.when(F.col("kind_") == "EC", N.spec("EC", curve=N.normalise_curve(_text(1)))).when(F.col("kind_") == "RSA", N.spec("RSA", key_size=_number(1))).otherwise(N.dynamic(F.lit("key type not written here"))))
        .otherwise(N.spec(F.col("family"), key_size=F.col("bits"), curve=F.col("curve_"), hash=F.col("hash"), mode=F.col("mode"), name=F.col("name"), parameters=params, notes=notes))
    )
    face = F.concat(F.lit("library:"), F.col("package"))
    return _result(found, 3, face, spec).unionByName(_result(found.where("also IS NOT NULL"), 3, face, N.spec(F.col("also"), curve=F.col("curve"), hash="SHA-256"), part=1))


def plain_uses(calls: DataFrame) -> DataFrame:
    """(path, package) of calls of members that do no cryptography: read, with nothing to report."""
    p = package_of(F.col("module"))
    key = F.array_join("members", ".")
    uses = calls.where("module IS NOT NULL").select("path", p["name"].alias("package"), key.alias("key"))
    hit = (F.col("key") == F.col("member")) | F.col("key").startswith(F.concat("member", F.lit(".")))
    return uses.join(F.broadcast(dims.plain_members(calls.sparkSession)), "package").where(hit).select("path", "package").distinct()


def jwt_default(calls: DataFrame) -> DataFrame:
    """jsonwebtoken's sign without an algorithm: HS256; one in a variable is dynamic."""
    used = calls.where((F.col("module") == "jsonwebtoken") & (F.array_join("members", ".") == "sign")).withColumn("operation", F.lit("sign"))
    options = _arg(2)
    alg = _field(options, "algorithm")
    default = N.spec("HMAC", hash="SHA-256", name="HS256", notes=["library-default"])
    spec = (
        F.when(options.isNull() | (options["kind"] == "function"), default)
        .when(options["kind"] == "object", F.when(alg.isNull(), default).when(alg["text"].isNull(), N.dynamic(F.lit("JWT algorithm not written here"))))
        .otherwise(N.dynamic(F.concat(F.lit("JWT options held in "), options["given"])))
    )
    return _result(used, 3, "library:jsonwebtoken", spec)


def jose_literals(fact: DataFrame) -> DataFrame:
    """JSON Web Algorithm names as literals, in files that import a package that takes them; several packages are all named."""
    takes = [r["package"] for r in dims.libraries(fact.sparkSession).where("jose").select("package").collect()]  # of the catalogue
    packages = F.array_sort(F.array_intersect("chain", F.array(*map(F.lit, takes))))
    strings = fact.where("kind = 'string'").withColumn("packages", packages).where(F.size("packages") > 0).withColumn("operation", F.lit("algorithm literal"))
    spec = F.when(F.col("name") == "none", F.when(F.col("alias"), N.spec("Unknown", name='JWT alg "none"', notes=["unsigned"]))).otherwise(N.jose(F.col("name")))
    return _result(strings, 3, F.concat(F.lit("library:"), F.array_join("packages", " or ")), spec)


def unread_imports(packages: DataFrame, used: DataFrame) -> DataFrame:
    """One pointer at the first import of a package whose uses the catalogue maps, where none was read; helper paths alone don't count."""
    helper = F.col("subpath").rlike(r"^(utils?|util/.*|utils/.*|types?)$")
    maps = F.broadcast(dims.libraries(packages.sparkSession).where("has_calls OR jose").select("package"))
    first = packages.join(maps, "package", "left_semi").groupBy("path", "package").agg(F.min_by(F.struct("line", "col", "ord", "evidence"), "ord").alias("s"), F.bool_and(helper).alias("helpers")).where("NOT helpers")
    left = first.join(large(used.select("path", "package").distinct()), ["path", "package"], "left_anti").select("path", "package", "s.*", F.lit("import").alias("operation"))
    return _result(left, 3, F.concat(F.lit("library:"), F.col("package")), N.dynamic(F.concat("package", F.lit(" imported; its uses here could not be read"))))


def findings(found: DataFrame, words: DataFrame, in_test: Column | None = None) -> DataFrame:
    """The report's columns: described, with notes and, for quantum-vulnerable uses, the priority that the words near them give; repeats removed.

    found is read twice, so it should be stored; words: lexical.words of the same
    files. The words of a file's name come after those near a use. Of findings that agree
    in place, algorithm, operation and interface, the first detector's stays.
    """
    s = F.col("spec")
    staged = found.withColumns({"algorithm": C.aside(N.display_name(s)), "family": s["family"], "kind": C.aside(N.kind_of(s["family"]))})
    described = staged.select(
        "algorithm", "family", C.aside(N.class_of(F.col("family"))).alias("class"), "kind", s["key_size"].alias("key_size"), s["curve"].alias("curve"), s["hash"].alias("hash"), s["parameters"].alias("parameters"),
        "interface", "operation", F.col("path").alias("file"), "line", F.col("col").alias("column"), "evidence", s["dynamic"].alias("dynamic"), C.aside(F.array_distinct(F.concat(N.note_codes(s, F.col("algorithm"), F.col("kind")), "extra"))).alias("notes"), "detector", "ord", "part",
    )
    first = W.Window.partitionBy("file", "line", "column", "algorithm", "operation", "interface").orderBy("detector", "ord", "part")
    described = described.repartition("file", "line")  # what the window and the join need, so the rows go over once
    once = described.withColumn("before", F.lag(F.lit(1)).over(first)).where("before IS NULL")  # few rows are repeats, so none are looked for ahead of the exchange
    vulnerable = F.col("class") == "public-key"
    lines = found.select("path", "line", s["family"].alias("family")).where(F.col("family").isin(*(f for (group, _), families in dims.FAMILIES.items() if group == "public-key" for f in families)))
    near = lexical.near_words(lines, words).select(F.col("path").alias("file"), "line", *dims.DECIDING)
    named = V.split_words(F.regexp_replace(F.regexp_extract("file", r"[^/]*$", 0), r"\.[^.]*$", ""))
    once = once.withColumn("quantum_vulnerable", vulnerable).join(large(near), ["file", "line"], "left")
    told = F.struct(*(F.coalesce(F.col(k), V.first_word(F.col("named"), pattern)).alias(k) for k, pattern in dims.DECIDING.items()))
    once = once.withColumn("named", F.when(vulnerable, named)).withColumn("told", C.once(told))
    out = once.withColumn("p", F.when(vulnerable, V.priority(F.col("kind"), *(F.col("told")[k] for k in dims.DECIDING))))
    return out.select(
        "algorithm", "family", "class", "kind", "quantum_vulnerable", "key_size", "curve", "hash", "parameters", "interface", "operation", "file", "line", "column", "evidence", "dynamic",
        F.col("p.priority").alias("priority"), F.col("p.word").alias("priority_word"), F.col("p.reason").alias("priority_reason"), V.replacement(F.col("p.priority")).alias("replacement"), "notes", (in_test if in_test is not None else F.lit(False)).alias("in_test"),
    )


class Detected(NamedTuple):
    """found: findings before they are described; packages: imports of catalogued ones; words and unread: as lexical gives them."""

    found: DataFrame
    packages: DataFrame
    calls: DataFrame
    words: DataFrame
    unread: DataFrame


def resolved(fact: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, constants): calls whose arguments are what constants of their file, or of one that it imports, set them to, and constants of the top level.

    fact is stored, so calls without names in their arguments are read from it; the
    others are stored anew, since detectors ask a call's arguments many times.
    """
    own = scopes.resolve(fact, lexical.calls(fact))
    constants = settle(own.constants)
    named = settle(lexical.with_imported(own.named, lexical.imported(fact, constants)), "zstd")
    return own.plain.unionByName(named), constants


def detect(files: DataFrame) -> Detected:
    """What files (path, text) say. The texts are read once: their facts are stored in the shared folder."""
    fact = settle(lexical.facts(files), "zstd")
    call, constants = resolved(fact)
    packages = imported_packages(lexical.import_sites(fact))
    named = library_calls(call).unionByName(jwt_default(call)).unionByName(jose_literals(fact))
    named = settle(named.select(*FOUND))  # stored, since unread_imports asks for it too
    each = named.select("path", F.explode(F.split(F.substring(F.col("interface"), 9, 1000), " or ")).alias("package"))
    used = each.union(plain_uses(call))
    found = named
    for part in (web_crypto(call), node_crypto(call), parameters(constants), unread_imports(packages, used)):
        found = found.unionByName(part.select(*FOUND))
    return Detected(settle(found, "zstd"), packages, call, lexical.words(fact), lexical.unread(fact))
