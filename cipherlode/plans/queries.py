"""Queries over the engine's operators, each with SQL that works the same rows out from the keys alone.

The driver's tables hold no source code, so most queries first turn rows into files
(a few lines of JavaScript, a lockfile, a server's configuration) by key arithmetic and
run the operators over those; the SQL never sees the files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.functions import bom as B
from cipherlode.functions import names as N
from cipherlode.functions import paths as P
from cipherlode.functions.code import aside
from cipherlode.functions.words import first_word, split_words
from cipherlode.operators import dependencies, detect, lexical, tls
from cipherlode.plans import cbom, report
from cipherlode.plans.scan import Scan, scan_table, settled
from cipherlode.sources import packages, tree
from cipherlode.store import settle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: str, texts: list[str]) -> Column:
    """texts[key % their number]."""
    return F.element_at(F.array(*map(F.lit, texts)), (F.col(key) % len(texts) + 1).cast("int"))


def pick_sql(key: str, texts: list[str | None]) -> str:
    return f"CASE {key} % {len(texts)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if t is None else "'" + t.replace("'", "''") + "'") for i, t in enumerate(texts)) + " END"


def files(rows: DataFrame, path: Column, text: Column) -> DataFrame:
    return rows.select(path.alias("path"), text.alias("text"))


def node_calls(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, facts) of files."""
    fact = settle(lexical.facts(source))
    return detect.resolved(fact)[0], fact


def described(calls: DataFrame, fact: DataFrame) -> DataFrame:
    """Findings of calls into node:crypto."""
    return detect.findings(settle(detect.node_crypto(calls).select(*detect.FOUND)), lexical.words(fact))


# Names


def _named(pairs: list[tuple[str, str | None]], of: Callable[[Column], Column], out: str) -> Query:
    return lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", pick("p_partkey", [a for a, _ in pairs]).alias("name")).select("p_partkey", "name", aside(of(F.col("name"))).alias(out))


_NAMES: dict[str, tuple[list[tuple[str, str | None]], Callable[[Column], Column], str]] = {
    "hash_names": ([("sha256", "SHA-256"), ("SHA-1", "SHA-1"), ("md5", "MD5"), ("sha512-256", "SHA-512/256"), ("SHA3-384", "SHA3-384"), ("shake128", "SHAKE128"), ("RIPEMD160", "RIPEMD-160"), ("rmd160", "RIPEMD-160"), ("blake2b512", "BLAKE2b-512"), ("blake2s", "BLAKE2s"), ("sm3", "SM3"), ("keccak256", "Keccak-256"), ("crc32", None), ("sha_224", "SHA-224"), ("sha/256", None), ("s-h-a-256", None), ("sha51-2/256", None), ("SHA-512/224", "SHA-512/224"), ("blake2b-264", "BLAKE2b-264"), ("sha3 512", "SHA3-512"), ("sha512256", None)], N.normalise_hash, "hash"),
    "curve_names": ([("prime256v1", "P-256"), ("secp256r1", "P-256"), ("P-384", "P-384"), ("p521", "P-521"), ("secp256k1", "secp256k1"), ("curve25519", "X25519"), ("brainpoolP256r1", "brainpoolP256r1"), ("Ed448", "Ed448")], N.normalise_curve, "curve"),
    "cipher_names": ([("aes-128-cbc", "AES-128-CBC"), ("aes256", "AES-256-CBC"), ("AES-256-GCM", "AES-256-GCM"), ("id-aes192-gcm", "AES-192-GCM"), ("aes-gcm", "AES-GCM"), ("des-ede3-cbc", "3DES-CBC"), ("des-cbc", "DES-CBC"), ("rc4", "RC4"), ("chacha20-poly1305", "ChaCha20-Poly1305"), ("bf-cbc", "Blowfish"), ("camellia-128", "camellia-128")], lambda c: N.display_name(N.cipher(c)), "algorithm"),
    "jose_names": ([("HS256", "HMAC"), ("RS512", "RSASSA-PKCS1-v1_5"), ("PS384", "RSA-PSS"), ("ES256", "ECDSA"), ("ES256K", "ECDSA"), ("EdDSA", "EdDSA"), ("RSA-OAEP-256", "RSA-OAEP"), ("RSA1_5", "RSAES-PKCS1-v1_5"), ("ECDH-ES+A128KW", "ECDH"), ("A256GCM", "AES"), ("A128CBC-HS256", "AES"), ("PBES2-HS256+A128KW", "PBKDF2"), ("ML-DSA-65", "ML-DSA"), ("es256", None), ("none", None)], lambda c: N.jose(c)["family"], "family"),
    "pq_names": ([("ML-KEM-768", "ML-KEM-768"), ("mlkem1024", "ML-KEM-1024"), ("ml-dsa-44", "ML-DSA-44"), ("SLH-DSA-SHA2-128s", "SLH-DSA-SHA2-128S"), ("kyber512", "Kyber512"), ("x25519mlkem768", "X25519MLKEM768"), ("x-wing", "X-Wing"), ("RSA", None)], lambda c: N.post_quantum(c)["name"], "algorithm"),
    "webcrypto_names": ([("AES-GCM", "AES-GCM"), ("hmac", "HMAC"), ("SHA-384", "SHA-384"), ("ECDSA", "ECDSA"), ("X25519", "X25519"), ("Ed25519", "Ed25519"), ("RSA-PSS", "RSA-PSS"), ("RSASSA-PKCS1-v1_5", "RSASSA-PKCS1-v1_5"), ("PBKDF2", "PBKDF2"), ("Argon2id", "Argon2id"), ("ML-KEM-768", "ML-KEM-768"), ("Serpent", "Serpent")], lambda c: N.display_name(N.webcrypto(c)), "algorithm"),
    "signature_names": ([("RSA-SHA256", "RSASSA-PKCS1-v1_5"), ("ecdsa-with-SHA1", "ECDSA"), ("sha256", "Signature"), ("ML-DSA-65", "ML-DSA"), ("whirlpool", "Unknown")], lambda c: N.signature(c)["family"], "family"),
    "key_types": ([("rsa", "RSA"), ("ec", "EC"), ("ed25519", "Ed25519"), ("x448", "X448"), ("dh", "DH"), ("dsa", "DSA"), ("ml-dsa-65", "ML-DSA"), ("other", "Unknown")], lambda c: N.key_type(c, *[F.lit(None)] * 4)["family"], "family"),
    "jwk_types": ([("RSA", "RSA"), ("AKP", "ML-DSA"), ("oct", None)], lambda c: N.jwk(c, F.lit(None).cast("string"))["family"], "family"),
    "class_of_family": ([("ECDH", "public-key"), ("ML-KEM", "post-quantum"), ("AES", "symmetric"), ("Hash", "hash"), ("scrypt", "kdf"), ("CSPRNG", "random"), ("Nothing", "unknown")], N.class_of, "class"),
    "bom_slugs": ([("AES-256-GCM 256", "aes-256-gcm-256"), ("@noble/curves", "noble-curves"), ("X.509", "x.509"), ("--", "x")], B.slug, "slug"),
    "tls_versions": ([("TLSv1.2 TLSv1.3", "1.3"), ("all -TLSv1.3", None), ("min TLSv1", "1.0"), ("SSLv3", None), ("tls1.2", "1.2")], lambda c: B.tls_version(F.split(F.regexp_replace(c, "^min ", "min_"), " ")), "version"),
    "file_kinds": ([("src/a.js", "js"), ("a/b.test.TSX", "js"), ("package.json", "manifest"), ("x/yarn.lock", "lockfile"), ("etc/nginx.conf", "tls"), ("Caddyfile.prod", "tls"), ("ssl-params", "tls"), ("README.md", None), ("nginx.js", "js"), ("my.package.json", None)], P.kind, "kind"),
}
for _name, (_pairs, _of, _out) in _NAMES.items():
    QUERIES[_name] = _named(_pairs, _of, _out)
    ORACLES[_name] = f"SELECT p_partkey, {pick_sql('p_partkey', [a for a, _ in _pairs])} AS name, {pick_sql('p_partkey', [b for _, b in _pairs])} AS {_out} FROM part"

_LEVELS = [("AES", 128, None, "AES-128-GCM", "symmetric", "cipher", 128, 1, "ae"), ("AES", 256, None, "AES-256-CBC", "symmetric", "cipher", 256, 5, "block-cipher"), ("RSA", 2048, None, "RSA 2048-bit", "public-key", "public-key", 112, 0, "unknown"), ("ECDH", None, "P-384", "ECDH P-384", "public-key", "key-agreement", 192, 0, "key-agree"), ("ML-KEM", None, None, "ML-KEM-768", "post-quantum", "kem", 192, 3, "kem"), ("ML-DSA", None, None, "ML-DSA-44", "post-quantum", "pq-signature", 128, 2, "signature"), ("Hash", None, None, "SHA-256", "hash", "hash", 128, 2, "hash"), ("Hash", None, None, "MD5", "hash", "hash", None, 0, "hash"), ("Ed448", None, None, "Ed448", "public-key", "signature", 224, 0, "signature"), ("ChaCha20", None, None, "ChaCha20", "symmetric", "cipher", 256, 5, "stream-cipher")]


@query(f"SELECT p_partkey, {pick_sql('p_partkey', [r[3] for r in _LEVELS])} AS algorithm, " + ", ".join(f"CAST({pick_sql('p_partkey', [None if r[i] is None else str(r[i]) for r in _LEVELS])} AS INTEGER) AS {name}" for i, name in ((6, "classical_level"), (7, "quantum_level"))) + f", {pick_sql('p_partkey', [r[8] for r in _LEVELS])} AS primitive FROM part")
def security_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda i: pick("p_partkey", [None if r[i] is None else str(r[i]) for r in _LEVELS])
    c = F.col
    rows = table(spark, sf_dir, "part").select("p_partkey", text(0).alias("family"), text(1).cast("bigint").alias("key_size"), text(2).cast("string").alias("curve"), text(3).alias("algorithm"), text(4).alias("class"), text(5).alias("kind"))
    classical, quantum = B.classical_level(c("class"), c("kind"), c("family"), c("algorithm"), c("key_size"), c("curve")), B.quantum_level(c("class"), c("kind"), c("family"), c("algorithm"), c("key_size"))
    return rows.select("p_partkey", "algorithm", classical.cast("int").alias("classical_level"), quantum.cast("int").alias("quantum_level"), B.primitive(c("kind"), c("family"), c("algorithm")).alias("primitive"))


# Paths


@query("SELECT p_partkey, p_partkey % 5 IN (0, 1, 3) AS in_test FROM part WHERE p_partkey % 7 <> 2")
def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(pick("p_partkey", ["src/tests/f", "src/f.test.", "src/testing/f", "spec/x/f", "lib/f"]), F.col("p_partkey").cast("string"), F.lit(".js"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(pick("p_partkey", ["a/", "b/", "skip/", "c/", "d/", "e/", "g/"]), path).alias("path"))
    return rows.where(~P.left_out(F.col("path"), ["./skip/"])).select("p_partkey", P.in_test(F.col("path")).alias("in_test"))


@query("SELECT CASE s_suppkey % 4 WHEN 1 THEN 'binary' WHEN 2 THEN 'unreadable (error)' END AS reason, count(*) AS n_files FROM supplier WHERE s_suppkey % 4 <> 3 GROUP BY 1")
def skipped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("s_suppkey") % 4 == 1, F.lit("a\0b")).when(F.col("s_suppkey") % 4 == 2, F.lit(None)).otherwise(F.lit("let a"))
    name = F.concat(pick("s_suppkey", ["src/", "src/", "src/", "node_modules/x/"]), F.col("s_suppkey").cast("string"), F.lit(".js"))
    return tree.read_table(files(table(spark, sf_dir, "supplier"), name, text)).groupBy("reason").agg(F.count("*").alias("n_files"))


# Words of documents


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z]+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(split_words(F.col("text"))).cast("bigint").alias("n_words"))


_SEAL_SQL = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z]+'), lambda w: lower(w)), lambda w: regexp_matches(w, '^(seal|unseal|encrypt|decrypt|(un)?wrap|stor(e|ed|es|age|ing)$|envelope|archiv|backup|persist)'))"


@query(f"SELECT doc_id, {_SEAL_SQL}[1] AS word FROM documents")
def first_seal_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cipherlode import dims

    return table(spark, sf_dir, "documents").select("doc_id", first_word(split_words(F.col("text")), dims.SEAL_WORDS).alias("word"))


# Node's crypto


_HASHES = [("md5", "MD5"), ("sha1", "SHA-1"), ("sha256", "SHA-256"), ("sha3-512", "SHA3-512")]


@query(f"SELECT {pick_sql('p_partkey', [b for _, b in _HASHES])} AS algorithm, count(*) AS n_uses FROM part GROUP BY 1")
def node_hash_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("const { createHash: h } = require('node:crypto');\n// h('md4')\nmodule.exports = (x) => h('"), pick("p_partkey", [a for a, _ in _HASHES]), F.lit("').update(x);\n"))
    calls, _ = node_calls(files(table(spark, sf_dir, "part"), F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".js")), text))
    return detect.node_crypto(calls).select(aside(N.display_name(F.col("spec"))).alias("algorithm")).groupBy("algorithm").agg(F.count("*").alias("n_uses"))


_PAIRS = [("'rsa', { modulusLength: 3072 }", "RSA 3072-bit"), ("'ec', { namedCurve: 'P-256' }", "EC P-256"), ("'ed25519'", "Ed25519"), ("'x25519'", "X25519"), ("'dh', { group: 'modp15' }", "DH 3072-bit"), ("kind", "dynamic (key type held in kind)")]


@query(f"SELECT s_suppkey, {pick_sql('s_suppkey', [b for _, b in _PAIRS])} AS algorithm, CAST(2 AS BIGINT) AS line FROM supplier")
def node_key_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("import { generateKeyPairSync } from 'crypto';\nexport const k = (kind) => generateKeyPairSync("), pick("s_suppkey", [a for a, _ in _PAIRS]), F.lit(");\n"))
    calls, _ = node_calls(files(table(spark, sf_dir, "supplier"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".mjs")), text))
    return detect.node_crypto(calls).select(F.regexp_extract("path", r"\d+", 0).cast("bigint").alias("s_suppkey"), aside(N.display_name(F.col("spec"))).alias("algorithm"), F.col("line").cast("bigint").alias("line"))


@query("SELECT s_suppkey, CAST(s_suppkey % 300 * 1000 + 1 AS BIGINT) AS iterations, s_suppkey % 300 * 1000 + 1 < 100000 AS few FROM supplier")
def node_pbkdf2(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("s_suppkey") % 300 * 1000 + 1).cast("string")
    text = F.concat(F.lit("const crypto = require('crypto');\nconst ROUNDS = "), n, F.lit(";\nexports.f = (p, s) => crypto.pbkdf2Sync(p, s, ROUNDS, 32, 'sha512');\n"))
    calls, _ = node_calls(files(table(spark, sf_dir, "supplier"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".js")), text))
    s = F.col("spec")
    found = detect.node_crypto(calls).where(s["family"] == "PBKDF2")
    return found.select(F.regexp_extract("path", r"\d+", 0).cast("bigint").alias("s_suppkey"), s["parameters"]["iterations"].cast("bigint").alias("iterations"), F.array_contains(N.note_codes(s, N.display_name(s), F.lit("kdf")), "pbkdf2-iterations").alias("few"))


#: Values by scope and shape, and what a call of createHash with them is.
_SCOPES = [
    ("function a() { const algo = 'md5' } function b(algo) { createHash(algo) }", "dynamic (hash held in algo)"), ("const algo = 'sha256'; function b() { const algo = 'md5'; createHash(algo) }", "MD5"),
    ("const a = 'md5', b = a, c = b, d = c, e = d, f = e; createHash(f)", "MD5"), ("createHash((((('sha1')))))", "SHA-1"), ("createHash(z ? 'md5' : 'md5')", "MD5"), ("createHash('md5', '" + "x" * 3500 + "')", "MD5"),
    ("createHash(z ? 'md5' : 'sha1')", "dynamic (hash held in z?'md5':'sha1')"), ("let algo = 'md5'; createHash(algo)", "dynamic (hash held in algo)"), ("createHash(`sha256`); const s = `${ [{ a: `}` }] } createHash('md4')`", "SHA-256"),
]


@query(f"SELECT o_orderkey, {pick_sql('o_orderkey', [b for _, b in _SCOPES])} AS algorithm FROM orders")
def scoped_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("import { createHash } from 'crypto';\n"), pick("o_orderkey", [a for a, _ in _SCOPES]))
    calls, _ = node_calls(files(table(spark, sf_dir, "orders"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".ts")), text))
    return detect.node_crypto(calls).select(F.regexp_extract("path", r"\d+", 0).cast("bigint").alias("o_orderkey"), aside(N.display_name(F.col("spec"))).alias("algorithm"))


#: Other methods, and what a call of them is.
_METHODS = [
    ("createHmac('sha384', k)", "HMAC-SHA-384", "createHmac"), ("createHmac('whirl', k)", "HMAC-whirl", "createHmac"), ("generateKeySync('aes', { length: 192 })", "AES-192", "generateKeySync"), ("generateKeySync('hmac', { length: 512 })", "HMAC", "generateKeySync"),
    ("createECDH('prime256v1')", "ECDH P-256", "createECDH"), ("createDiffieHellman(2048)", "DH 2048-bit", "createDiffieHellman"), ("getDiffieHellman('modp14')", "DH 2048-bit", "getDiffieHellman"), ("diffieHellman({ privateKey: k, publicKey: p })", "DH/ECDH", "diffieHellman"),
    ("publicEncrypt(k, d)", "RSA-OAEP", "publicEncrypt"), ("publicEncrypt({ key: k, padding: c.constants.RSA_PKCS1_PADDING }, d)", "RSAES-PKCS1-v1_5", "publicEncrypt"), ("privateEncrypt(k, d)", "RSA raw signature", "privateEncrypt"),
    ("createPublicKey({ key: { kty: 'OKP', crv: 'Ed25519', x }, format: 'jwk' })", "Ed25519", "createPublicKey"), ("createPrivateKey(pem)", "dynamic (key type set by the key material)", "createPrivateKey"), ("KeyObject.from(k)", "dynamic (key type set by the key)", "KeyObject.from"),
    ("encapsulate(k)", "dynamic (key encapsulation: the algorithm is set by the key)", "encapsulate"), ("hkdfSync('sha256', k, s, i, 32)", "HKDF-SHA-256", "hkdfSync"),
]


@query(f"SELECT p_partkey, {pick_sql('p_partkey', [b for _, b, _ in _METHODS])} AS algorithm, {pick_sql('p_partkey', [m for _, _, m in _METHODS])} AS operation FROM part")
def node_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("import c from 'node:crypto';\nexport const f = (k, d, p, s, i, x, pem) => c."), pick("p_partkey", [a for a, _, _ in _METHODS]), F.lit(";\n"))
    calls, _ = node_calls(files(table(spark, sf_dir, "part"), F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".mjs")), text))
    return detect.node_crypto(calls).select(F.regexp_extract("path", r"\d+", 0).cast("bigint").alias("p_partkey"), aside(N.display_name(F.col("spec"))).alias("algorithm"), "operation")


_COUNTS = [("const PBKDF2_ITERATIONS = 1e5;", 100000), ("export const pbkdf2Rounds = 0x2710;", 10000), ("const ITERATIONS = 5;", None), ("let PBKDF2_ITERATIONS = 5;", None), ("function f() { const PBKDF2_ITERATIONS = 5; }", None), ("const kPbkdf2IterCount = 600_000;", 600000)]


@query(f"SELECT * FROM (SELECT s_suppkey, CAST({pick_sql('s_suppkey', [None if b is None else str(b) for _, b in _COUNTS])} AS BIGINT) AS iterations FROM supplier) WHERE iterations IS NOT NULL")
def declared_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = settle(lexical.facts(files(table(spark, sf_dir, "supplier"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".ts")), pick("s_suppkey", [a for a, _ in _COUNTS]))))
    return detect.parameters(detect.resolved(fact)[1]).select(F.regexp_extract("path", r"\d+", 0).cast("bigint").alias("s_suppkey"), F.col("spec")["parameters"]["iterations"].cast("bigint").alias("iterations"))


@query("SELECT CAST(0 AS BIGINT) AS n_findings, count(*) AS n_files FROM part")
def traps_report_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    traps = ["// crypto.createHash('md5')\n", "/* crypto.createHash('md5')\n */\n", "const s = \"crypto.createHash('md5')\";\n", "const t = `crypto.createHash('md5')`;\n", "const r = /crypto.createHash('md5')/;\n", "class A { createHash(a) { return a; } }\n", "helper.createHash('md5');\n"]
    source = files(table(spark, sf_dir, "part"), F.concat(F.lit("t"), F.col("p_partkey").cast("string"), F.lit(".js")), F.concat(F.lit("import crypto from 'node:crypto';\n"), pick("p_partkey", traps)))
    calls, _ = node_calls(source)
    return detect.node_crypto(calls).agg(F.count("*").alias("n_findings")).crossJoin(source.agg(F.count("*").alias("n_files")))  # one row each


# Web Crypto


_SUBTLE = [("generateKey({ name: 'ECDH', namedCurve: 'P-256' }, true, [])", "ECDH P-256", "public-key"), ("encrypt({ name: 'AES-GCM', iv }, k, d)", "AES-GCM", "symmetric"), ("digest('SHA-512', d)", "SHA-512", "hash"), ("sign(ALG, k, d)", "Ed25519", "public-key"), ("deriveBits({ name: 'PBKDF2', hash: 'SHA-256', iterations: 5000, salt }, k, 256)", "PBKDF2-SHA-256", "kdf")]


def _subtle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("const ALG = 'Ed25519';\nexport const f = (iv, salt, k, d) =>\n  globalThis.crypto.subtle."), pick("o_orderkey", [a for a, _, _ in _SUBTLE]), F.lit(";\n"))
    return files(table(spark, sf_dir, "orders"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".js")), text)


def _web(source: DataFrame) -> DataFrame:
    return detect.web_crypto(node_calls(source)[0])


@query(f"SELECT {pick_sql('o_orderkey', [b for _, b, _ in _SUBTLE])} AS algorithm, {pick_sql('o_orderkey', [c for _, _, c in _SUBTLE])} AS class, count(*) AS n_uses FROM orders GROUP BY 1, 2")
def webcrypto_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("spec")
    return _web(_subtle_files(spark, sf_dir)).select(aside(N.display_name(s)).alias("algorithm"), aside(N.class_of(s["family"])).alias("class")).groupBy("algorithm", "class").agg(F.count("*").alias("n_uses"))


#: Ways to the interface, and what is called through them.
_WAYS = [
    ("let s;\ns = globalThis.crypto.subtle;\ns.digest('SHA-1', d);", "SHA-1"), ("function f(s = window.crypto.subtle) { return s.digest('SHA-256', d); }", "SHA-256"), ("const { subtle: s } = self.crypto; s.digest('SHA-384', d);", "SHA-384"),
    ("crypto.getRandomValues(a);", "Random (CSPRNG)"), ("const id = window.crypto.randomUUID();", "Random (CSPRNG)"), ("const s = store.subtle2; s.digest('SHA-512', d);", None),
]


@query(f"SELECT * FROM (SELECT c_custkey, {pick_sql('c_custkey', [b for _, b in _WAYS])} AS algorithm FROM customer) WHERE algorithm IS NOT NULL")
def webcrypto_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _web(files(table(spark, sf_dir, "customer"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".js")), pick("c_custkey", [a for a, _ in _WAYS])))
    return found.select(F.regexp_extract("path", r"\d+", 0).cast("bigint").alias("c_custkey"), aside(N.display_name(F.col("spec"))).alias("algorithm"))


@query("SELECT c_custkey, a.algorithm, CAST(2 AS BIGINT) AS line FROM customer, (VALUES ('RSA-OAEP'), ('AES-256-GCM')) a(algorithm)")
def unwrap_two_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("const s = window.crypto.subtle;\ns.unwrapKey('raw', w, k, { name: 'RSA-OAEP' }, { name: 'AES-GCM', length: 256 }, false, []);\n")
    found = _web(files(table(spark, sf_dir, "customer"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".js")), text))
    return found.select(F.regexp_extract("path", r"\d+", 0).cast("bigint").alias("c_custkey"), aside(N.display_name(F.col("spec"))).alias("algorithm"), F.col("line").cast("bigint").alias("line"))


@query("SELECT user_id, 'ECDH ' || CASE user_id % 3 WHEN 0 THEN 'P-256' WHEN 1 THEN 'P-384' ELSE 'P-521' END AS algorithm FROM (SELECT DISTINCT user_id FROM events)")
def imported_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    name = F.col("user_id").cast("string")
    params = files(users, F.concat(F.lit("u"), name, F.lit("/params.ts")), F.concat(F.lit("export const CURVE = '"), pick("user_id", ["P-256", "P-384", "P-521"]), F.lit("';\n")))
    uses = files(users, F.concat(F.lit("u"), name, F.lit("/keys.js")), F.lit("import { CURVE as C } from './params.js';\nexport default () => crypto.subtle.generateKey({ name: 'ECDH', namedCurve: C }, true, ['deriveBits']);\n"))
    return _web(params.union(uses)).select(F.regexp_extract("path", r"\d+", 0).cast("bigint").alias("user_id"), aside(N.display_name(F.col("spec"))).alias("algorithm"))


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'high' WHEN o_orderkey % 4 = 1 THEN 'low' WHEN o_orderkey % 4 = 2 THEN 'medium' ELSE 'high' END AS priority, CASE o_orderkey % 4 WHEN 0 THEN 'backup' WHEN 1 THEN 'session' WHEN 2 THEN 'jwt' END AS word, count(*) AS n_uses FROM orders GROUP BY 1, 2")
def priority_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("const c = require('crypto');\n// for the "), pick("o_orderkey", ["backup", "session", "jwt", "thing"]), F.lit("\nexports.k = () => c.generateKeyPairSync('rsa', { modulusLength: 2048 });\n"))
    calls, fact = node_calls(files(table(spark, sf_dir, "orders"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".js")), text))
    return described(calls, fact).select("priority", F.col("priority_word").alias("word")).groupBy("priority", "word").agg(F.count("*").alias("n_uses"))


_NEAR = [("backup", "high"), ("session", "low"), ("jwt", "medium")]
_FAR = f"c_custkey % 11 > {lexical.NEAR} + CAST(c_custkey // 33 % 3 = 2 AS INTEGER)"


@query(f"SELECT c_custkey, CASE WHEN {_FAR} THEN 'high' ELSE {pick_sql('(c_custkey // 11)', [b for _, b in _NEAR])} END AS priority, CASE WHEN NOT {_FAR} THEN {pick_sql('(c_custkey // 11)', [a for a, _ in _NEAR])} END AS word FROM customer")
def nearby_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word of code, of a comment or of a comment over two lines, 0 to 10 lines above a use: within eight lines of its last one it decides."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 11).cast("int").alias("d"), F.floor(F.col("c_custkey") / 11).alias("w"), F.floor(F.col("c_custkey") / 33).alias("f"))
    call, word = F.lit("exports.k = () => c.generateKeyPairSync('rsa', { modulusLength: 2048 });"), pick("w", [a for a, _ in _NEAR])
    form = F.element_at(F.array(F.concat(word, F.lit("();")), F.concat(F.lit("// "), word), F.concat(F.lit("/* "), word, F.lit("\n*/"))), (F.col("f") % 3 + 1).cast("int"))
    lines = F.when(F.col("d") == 0, F.concat(call, F.lit(" "), form)).otherwise(F.concat(form, F.repeat(F.lit("\n"), F.col("d") - F.when(F.col("f") % 3 == 2, 1).otherwise(0)), call))
    calls, fact = node_calls(files(rows, F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".js")), F.concat(F.lit("const c = require('crypto');\n"), lines)))
    return described(calls, fact).select(F.regexp_extract("file", r"\d+", 0).cast("bigint").alias("c_custkey"), "priority", F.col("priority_word").alias("word"))


#: Legal text that readers stumble over, and what it uses.
_AWKWARD = [
    ("export const S = '\\ud83d\\ude00', L = '\\ud800'; createHash('md5', S);", "MD5"), ("export const M = 1e999, N = -1e999; createHash('sha1');", "SHA-1"), (f"export const M = {'9' * 5000}n; createHash('sha256', {'9' * 4400});", "SHA-256"),
    ("const a = z ? { name: a } : { name: a }; createHash(a);", "dynamic (hash held in a)"), (f"createHash({'q ? \'md5\' : ' * 1500}'md5');", "MD5"), (f"createHash({'q ? \'md5\' : ' * 1500}'sha1');", "dynamic (hash held in q)"),
    (f"createHash({'(q ? ' * 400}'md5'{' : 1)' * 400});", "dynamic (hash held in q)"), ("const a = q ? b : b, b = q ? a : a; createHash(q ? a : b);", "dynamic (hash held in q)"), ("createHash(q ? r ? 'md5' : 'md5' : 'md5');", "MD5"), (f"createHash({'(' * 2000}'sha512'{')' * 2000});", "SHA-512"),
]


@query(f"SELECT p_partkey, {pick_sql('p_partkey', [b for _, b in _AWKWARD])} AS algorithm FROM part")
def awkward_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped surrogates, infinite and very long numbers, constants that name themselves, long and deep conditionals: no file ends a scan."""
    text = F.concat(F.lit("import { createHash } from 'node:crypto';\n"), pick("p_partkey", [a for a, _ in _AWKWARD]), F.lit("\n"))
    calls, _ = node_calls(files(table(spark, sf_dir, "part"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".js")), text))
    algorithm = F.regexp_replace(aside(N.display_name(F.col("spec"))), r"^dynamic \(hash held in \W*(\w+).*$", "dynamic (hash held in $1)")
    return detect.node_crypto(calls).select(F.regexp_extract("path", r"\d+", 0).cast("bigint").alias("p_partkey"), algorithm.alias("algorithm"))


# Libraries


_LIBRARY = [("import nacl from 'tweetnacl';\nnacl.box.keyPair();\n", "X25519-XSalsa20-Poly1305", "box.keyPair"), ("import nacl from 'tweetnacl';\nnacl.sign.detached(m, k);\n", "Ed25519", "sign.detached"), ("import { x25519 } from '@noble/curves/ed25519';\nx25519.getPublicKey(k);\n", "X25519", "x25519.getPublicKey"), ("const s = require('libsodium-wrappers');\ns.crypto_box_seal(m, k);\n", "X25519 sealed box", "crypto_box_seal"), ("const s = require('libsodium-wrappers');\ns.crypto_box_easy(m, k);\n", "X25519-XSalsa20-Poly1305", "crypto_box_easy"), ("import md5 from 'crypto-js/md5';\nmd5(x);\n", "MD5", "()")]


def _library_files(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    return files(table(spark, sf_dir, "customer"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".js")), pick("c_custkey", texts))


@query(f"SELECT {pick_sql('c_custkey', [b for _, b, _ in _LIBRARY])} AS algorithm, {pick_sql('c_custkey', [c for _, _, c in _LIBRARY])} AS operation, count(*) AS n_uses FROM customer GROUP BY 1, 2")
def library_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, _ = node_calls(_library_files(spark, sf_dir, [a for a, _, _ in _LIBRARY]))
    return detect.library_calls(calls).select(aside(N.display_name(F.col("spec"))).alias("algorithm"), "operation").groupBy("algorithm", "operation").agg(F.count("*").alias("n_uses"))


@query("SELECT c_custkey, CAST(1 AS BIGINT) AS line FROM customer WHERE c_custkey % 3 = 1")
def library_unread_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _library_files(spark, sf_dir, ["import nacl from 'tweetnacl';\nnacl.hash(x);\n", "import nacl from 'tweetnacl';\nnacl[name](x);\n", "import u from '@noble/hashes/utils';\nu.bytes(x);\n"])
    calls, fact = node_calls(source)
    uses = detect.library_calls(calls).select("path", F.substring(F.col("interface"), 9, 1000).alias("package"))
    found = detect.unread_imports(detect.imported_packages(lexical.import_sites(fact)), uses)
    return found.select(F.regexp_extract("path", r"\d+", 0).cast("bigint").alias("c_custkey"), F.col("line").cast("bigint").alias("line"))


_BELOW = ["import md5 from 'crypto-js/md5';\nmd5(x);\n", "import mac from 'crypto-js/hmac-sha256';\nmac(x, k);\n", "import md5 from 'crypto-js/md5';\nmd5.other(x);\n"]


@query("SELECT CASE c_custkey % 3 WHEN 0 THEN 'MD5' ELSE 'HMAC-SHA-256' END AS algorithm, count(*) AS n_uses FROM customer WHERE c_custkey % 3 < 2 GROUP BY 1")
def library_subpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module below a package is an algorithm by itself when it is called, and not when a member of it is."""
    calls, _ = node_calls(_library_files(spark, sf_dir, _BELOW))
    return detect.library_calls(calls).select(aside(N.display_name(F.col("spec"))).alias("algorithm")).groupBy("algorithm").agg(F.count("*").alias("n_uses"))


_DECODED = ["import jwt from 'jsonwebtoken';\njwt.decode(x);\n", "import jwt from 'jsonwebtoken';\nlet y = jwt;\n", "import { errors } from 'jose';\nerrors.make(x);\n", "import { errorsOf } from 'jose';\nerrorsOf(x);\n"]


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN 'jsonwebtoken' ELSE 'jose' END AS package, c_custkey % 2 = 0 AS plain FROM customer")
def library_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that do no cryptography count as read and report nothing; a package of which nothing was read is reported."""
    calls, fact = node_calls(_library_files(spark, sf_dir, _DECODED))
    plain = settle(detect.plain_uses(calls))
    unread = detect.unread_imports(detect.imported_packages(lexical.import_sites(fact)), plain)
    rows = plain.select("path", "package", F.lit(True).alias("plain")).union(unread.select("path", F.regexp_replace("interface", "^library:", ""), F.lit(False)))
    return rows.select(F.regexp_extract("path", r"\d+", 0).cast("bigint").alias("c_custkey"), "package", "plain")


@query("SELECT CASE o_orderkey % 3 WHEN 0 THEN 'ES256' WHEN 1 THEN 'JWT alg \"none\"' END AS algorithm, count(*) AS n_uses FROM orders WHERE o_orderkey % 3 < 2 GROUP BY 1")
def jose_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("import { SignJWT } from 'jose';\nconst o = "), pick("o_orderkey", ["{ alg: 'ES256' }", "{ algorithms: ['none'] }", "{ display: 'none' }"]), F.lit(";\n"))
    source = files(table(spark, sf_dir, "orders"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".js")), text)
    fact = lexical.facts(source)
    found = detect.jose_literals(fact)
    return found.select(aside(N.display_name(F.col("spec"))).alias("algorithm")).groupBy("algorithm").agg(F.count("*").alias("n_uses"))


@query("SELECT CASE o_orderkey % 3 WHEN 0 THEN 'HS256' WHEN 1 THEN 'dynamic (JWT options held in opts)' END AS algorithm, count(*) AS n_uses FROM orders WHERE o_orderkey % 3 < 2 GROUP BY 1")
def jwt_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("const jwt = require('jsonwebtoken');\nexports.t = (p, k, opts) => jwt.sign(p, k"), pick("o_orderkey", ["", ", opts", ", { algorithm: 'RS256' }"]), F.lit(");\n"))
    calls, _ = node_calls(files(table(spark, sf_dir, "orders"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".js")), text))
    return detect.jwt_default(calls).select(aside(N.display_name(F.col("spec"))).alias("algorithm")).groupBy("algorithm").agg(F.count("*").alias("n_uses"))


# TLS


_TLS = [
    ("nginx", "server {\n  listen 443 ssl; # https\n  ssl_protocols TLSv1.2 TLSv1.3;\n  ssl_ecdh_curve X25519MLKEM768:X25519;\n}\n", "hybrid", None, 4), ("nginx", "server {\n  listen 443 ssl;\n  ssl_protocols TLSv1 TLSv1.2;\n  ssl_ecdh_curve \"prime256v1\";\n  ssl_ciphers HIGH:RC4-SHA;\n}\n", "classical-only", "low", 4),
    ("nginx", "server {\n  listen 80;\n  ssl_certificate x.pem;\n}\n", "unstated", None, 2), ("apache", "<VirtualHost *>\nSSLEngine on\nSSLProtocol all -SSLv3 \\\n  -TLSv1 -TLSv1.1\nSSLOpenSSLConfCmd Groups X25519:P-256\n</VirtualHost>\n", "classical-only", "low", 5),
    ("caddy", "a.example {\n  tls {\n    protocols tls1.2 tls1.3\n    curves x25519mlkem768 x25519\n  }\n}\n", "hybrid", None, 4),
]


def _tls_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("/"), pick("s_suppkey", ["nginx.conf", "site.conf", "default.conf", "httpd.conf", "Caddyfile"]))
    return files(table(spark, sf_dir, "supplier"), name, pick("s_suppkey", [t[1] for t in _TLS]))


@query(f"SELECT s_suppkey, {pick_sql('s_suppkey', [t[0] for t in _TLS])} AS server, {pick_sql('s_suppkey', [t[2] for t in _TLS])} AS key_exchange, {pick_sql('s_suppkey', [t[3] for t in _TLS])} AS priority, CAST({pick_sql('s_suppkey', [str(t[4]) for t in _TLS])} AS INTEGER) AS line FROM supplier")
def tls_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tls.judge(tls.file_configurations(_tls_files(spark, sf_dir))).select(F.regexp_extract("file", r"\d+", 0).cast("bigint").alias("s_suppkey"), "server", "key_exchange", "priority", "line")


@query("SELECT n.code, count(*) AS n_configurations FROM supplier, (VALUES (1, 'old-protocol'), (1, 'weak-ciphers'), (2, 'groups-unstated')) n(k, code) WHERE s_suppkey % 5 = n.k GROUP BY 1")
def tls_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tls.judge(tls.file_configurations(_tls_files(spark, sf_dir))).select(F.explode("notes").alias("code")).groupBy("code").agg(F.count("*").alias("n_configurations"))


@query("SELECT CASE WHEN count(DISTINCT k) = 1 THEN max(k) WHEN count(*) FILTER (k = 'hybrid') = 0 THEN 'classical-only' ELSE 'mixed' END AS key_exchange FROM (SELECT CASE s_suppkey % 5 WHEN 0 THEN 'hybrid' WHEN 4 THEN 'hybrid' WHEN 2 THEN 'unstated' ELSE 'classical-only' END AS k FROM supplier)")
def tls_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tls.overall(tls.judge(tls.file_configurations(_tls_files(spark, sf_dir))))


_NODE_TLS = [("https.createServer({ ecdhCurve: 'X25519MLKEM768', minVersion: 'TLSv1.2' })", "hybrid"), ("https.createServer({ ecdhCurve: CURVES })", "classical-only"), ("https.createServer(options)", "dynamic"), ("https.get('https://a.example')", None)]


@query(f"SELECT {pick_sql('c_custkey', [b for _, b in _NODE_TLS])} AS key_exchange, count(*) AS n_configurations FROM customer WHERE c_custkey % 4 < 3 GROUP BY 1")
def node_tls_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("import https from 'node:https';\nconst CURVES = 'P-256:X25519';\nexport const s = (options) => "), pick("c_custkey", [a for a, _ in _NODE_TLS]), F.lit(";\n"))
    calls, _ = node_calls(files(table(spark, sf_dir, "customer"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".mjs")), text))
    return tls.judge(tls.node_configurations(calls)).groupBy("key_exchange").agg(F.count("*").alias("n_configurations"))


# Packages


def _supplier_files(spark: SparkSession, sf_dir: str, name: str, text: Column) -> DataFrame:
    return files(table(spark, sf_dir, "supplier"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(f"/{name}")), text)


_NUMBER = "s_suppkey % 90"


def _key() -> Column:
    return F.regexp_extract("path", r"\d+", 0).cast("bigint").alias("s_suppkey")


def _version() -> Column:
    return (F.col("s_suppkey") % 90).cast("string")


@query(f"SELECT s_suppkey, p.package, CASE p.package WHEN 'jws' THEN '4.0.' || ({_NUMBER}) ELSE '3.1.' || ({_NUMBER}) END AS version, p.package = 'jws' AND s_suppkey % 2 = 1 AS dev FROM supplier, (VALUES ('jws'), ('elliptic')) p(package)")
def npm_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.concat(F.lit('{"lockfileVersion": 3, "packages": {"": {"name": "x"}, "node_modules/jws": {"version": "4.0.'), _version(), F.lit('", "dev": true}, "node_modules/a/node_modules/elliptic": {"version": "3.1.'), _version(), F.lit('"}}}'))
    nested = F.concat(F.lit('{"lockfileVersion": 1, "dependencies": {"jws": {"version": "4.0.'), _version(), F.lit('", "dependencies": {"elliptic": {"version": "3.1.'), _version(), F.lit('"}}}}}'))
    locks = _supplier_files(spark, sf_dir, "package-lock.json", F.when(F.col("s_suppkey") % 2 == 1, flat).otherwise(nested))
    return packages.lock_packages(locks).select(_key(), "package", "version", "dev")


@query(f"SELECT s_suppkey, p.package, CASE p.package WHEN 'jose' THEN '5.' || ({_NUMBER}) || '.0' ELSE 'unknown' END AS version, p.package = 'jws' AS dev FROM supplier, (VALUES ('jose'), ('jws')) p(package)")
def npm_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link of a workspace has the version of what it resolves to, or none that is known."""
    text = F.concat(F.lit('{"lockfileVersion": 3, "packages": {"": {"name": "x"}, "node_modules/jose": {"resolved": "packages/jose", "link": true}, "packages/jose": {"version": "5.'), _version(), F.lit('.0"}, "node_modules/jws": {"resolved": "gone", "link": true, "dev": true}}}'))
    return packages.lock_packages(_supplier_files(spark, sf_dir, "package-lock.json", text)).select(_key(), "package", "version", "dev")


@query("SELECT s_suppkey, 'p' || i AS package, '1.' || (s_suppkey % 90) || '.' || i AS version, i % 3 = 0 AS dev FROM supplier, range(1, 41) t(i)")
def npm_nested_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lockfiles of the first version, forty levels deep: each package has the next one among its own."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    text = F.expr("""aggregate(sequence(40, 1, -1), '', (below, i) -> concat('"dependencies": {"p', i, '": {"version": "1.', s_suppkey % 90, '.', i, '", "requires": {"x": "1"}', if(i % 3 = 0, ', "dev": true', ''), if(below = '', '', ', '), below, '}}'))""")
    locks = files(rows, F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("/package-lock.json")), F.concat(F.lit('{"lockfileVersion": 1, '), text, F.lit("}")))
    return packages.lock_packages(locks).select(_key().alias("s_suppkey"), "package", "version", "dev")


@query(f"SELECT s_suppkey, p.package, CASE p.package WHEN '@noble/hashes' THEN '1.4.' ELSE '6.5.' END || ({_NUMBER}) AS version FROM supplier, (VALUES ('@noble/hashes'), ('elliptic')) p(package)")
def yarn_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('# yarn\n\n__metadata:\n  version: 6\n\n"@noble/hashes@^1.0.0", "@noble/hashes@npm:^1.1.0":\n  version "1.4.'), _version(), F.lit('"\n  resolved "x"\n\nelliptic@^6.0.0:\n  version: 6.5.'), _version(), F.lit("\n"))
    return packages.lock_packages(_supplier_files(spark, sf_dir, "yarn.lock", text)).select(_key(), "package", "version")


@query(f"SELECT s_suppkey, p.package, CASE p.package WHEN 'mlkem' THEN '2.3.' ELSE '1.9.' END || ({_NUMBER}) AS version, CASE WHEN s_suppkey % 3 < 2 AND p.package = 'mlkem' THEN true END AS dev FROM supplier, (VALUES ('mlkem'), ('@noble/curves')) p(package)")
def pnpm_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = [("5.4", "/mlkem/2.3.", "/@noble/curves/1.9."), ("'6.0'", "/mlkem@2.3.", "/@noble/curves@1.9."), ("'9.0'", "mlkem@2.3.", "'@noble/curves@1.9.")]
    made = [F.concat(F.lit(f"lockfileVersion: {v}\n\nsettings:\n  x: 1\n\npackages:\n\n  {a}"), _version(), F.lit(":\n    resolution: {integrity: y}\n" + ("    dev: true\n" if i < 2 else "") + f"\n  {b}"), _version(), F.lit(("'" if b.startswith("'") else "") + ":\n    resolution: {integrity: z}\n\nsnapshots:\n\n  other@1.0.0: {}\n")) for i, (v, a, b) in enumerate(heads)]
    locks = _supplier_files(spark, sf_dir, "pnpm-lock.yaml", F.element_at(F.array(*made), (F.col("s_suppkey") % 3 + 1).cast("int")))
    return packages.lock_packages(locks).select(_key(), "package", "version", "dev")


def _named_packages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What a manifest and a lockfile of each supplier declare and lock, what each line of an order imports, and the suppliers' own names."""
    manifests = _supplier_files(spark, sf_dir, "package.json", F.concat(F.lit('{"name": "'), pick("s_suppkey", ["app", "jose"]), F.lit('", "dependencies": {"bcrypt": "^5.'), (F.col("s_suppkey") % 3).cast("string"), F.lit('.0", "jose": "^5.0.0", "left-pad": "1"}, "devDependencies": {"elliptic": "^6.0.0"}}')))
    locks = _supplier_files(spark, sf_dir, "yarn.lock", F.concat(F.lit("elliptic@^6.0.0:\n  version: 6.5."), (F.col("s_suppkey") % 2).cast("string"), F.lit("\n")))
    sites = table(spark, sf_dir, "lineitem").select(pick("l_partkey", ["bcrypt", "elliptic", "elliptic", "left-pad"]).alias("package"), F.concat(F.lit("src/o"), F.col("l_orderkey").cast("string"), F.lit(".js")).alias("path"), F.col("l_linenumber").alias("line"))
    return packages.manifest_packages(manifests), packages.lock_packages(locks), sites, packages.manifest_names(manifests)


@query("SELECT 'bcrypt' AS package, (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT '^5.' || (s_suppkey % 3) || '.0 (declared)' AS v FROM supplier)) AS versions, true AS direct, false AS dev, (SELECT count(*) FROM supplier) AS n_declared, CAST(0 AS BIGINT) AS n_lockfiles UNION ALL SELECT 'elliptic', (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT '6.5.' || (s_suppkey % 2) AS v FROM supplier)), true, true, (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier)")
def dependency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.roll_up(*_named_packages(spark, sf_dir)).select("package", F.array_join("versions", ", ").alias("versions"), "direct", "dev", F.col("n_declared_in").alias("n_declared"), "n_lockfiles")


@query(f"""SELECT 'bcrypt' AS package, 'declared_in' AS what, count(*) AS n_places, CAST(NULL AS BIGINT) AS last_line FROM supplier UNION ALL SELECT 'elliptic', 'declared_in', count(*), NULL FROM supplier UNION ALL SELECT 'elliptic', 'lockfiles', count(*), NULL FROM supplier
UNION ALL SELECT package, 'imported_at', count(DISTINCT (l_orderkey, l_linenumber)), CAST(max(l_linenumber) AS BIGINT) FROM (SELECT {pick_sql("l_partkey % 4", ["bcrypt", "elliptic", "elliptic", "left-pad"])} AS package, l_orderkey, l_linenumber FROM lineitem) WHERE package <> 'left-pad' GROUP BY package""")
def dependency_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that every order imports: places are rows, each once."""
    return dependencies.places(*_named_packages(spark, sf_dir)).groupBy("package", "what").agg(F.count("*").alias("n_places"), F.max("line").alias("last_line"))


# Reports: one file an order, one call a line


_LINES = [("c.createHash('md5').update(x);", "MD5", "hash", "weak-hash"), ("c.createHash('sha256').update(x);", "SHA-256", "hash", None), ("c.createCipheriv('aes-128-cbc', k, v);", "AES-128-CBC", "symmetric", "aes-128"), ("c.createECDH('prime256v1');", "ECDH P-256", "public-key", None), ("c.generateKeyPairSync('rsa', { modulusLength: 2048 });", "RSA 2048-bit", "public-key", None), ("c.randomBytes(16);", "Random (CSPRNG)", "random", None), ("c.pbkdf2Sync(p, s, 1000, 32, 'sha256');", "PBKDF2-SHA-256", "kdf", "pbkdf2-iterations"), ("c.createSign('RSA-SHA256');", "RSASSA-PKCS1-v1_5", "public-key", None)]
_ORDERED = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
#: One row a use: file, line, k (which call), priority. The word "sign" of a createSign up to eight lines above makes an RSA key one that signs.
_USES = f"""WITH l AS (SELECT l_orderkey, l_partkey % 8 AS k, 1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDERED}) AS line FROM lineitem),
u AS (SELECT *, {pick_sql("k", [a for _, a, _, _ in _LINES])} AS algorithm, {pick_sql("k", [c for _, _, c, _ in _LINES])} AS class, {pick_sql("k", [n for _, _, _, n in _LINES])} AS note,
CASE k WHEN 3 THEN 'high' WHEN 7 THEN 'medium' WHEN 4 THEN CASE WHEN max(CASE WHEN k = 7 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY line ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) = 1 THEN 'medium' ELSE 'high' END END AS priority FROM l)"""


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file an order, one call for each of its lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*_ORDERED.split(", "), pick("l_partkey", [a for a, _, _, _ in _LINES]).alias("code")).alias("l"))
    made = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return files(made, F.concat(F.lit("src/o"), F.col("l_orderkey").cast("string"), F.lit(".js")), F.concat(F.lit("const c = require('crypto');\n"), F.array_join(F.transform("l", lambda x: x["code"]), "\n"), F.lit("\n")))


def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(described(*node_calls(order_files(spark, sf_dir))))


def _no_tls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "priority string")


@query(f"{_USES} SELECT c.class, count(l_orderkey) AS n_findings, count(l_orderkey) FILTER (u.class = 'public-key') AS n_vulnerable, count(DISTINCT l_orderkey) AS n_files FROM (VALUES ('public-key'), ('post-quantum'), ('symmetric'), ('hash'), ('kdf'), ('random'), ('unknown')) c(class) LEFT JOIN u ON u.class = c.class GROUP BY 1")
def summary_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a whole scan of the generated tree, counted by class."""
    return report.by_class(scan_table(order_files(spark, sf_dir)).findings)


@query(f"{_USES} SELECT p.priority, count(l_orderkey) AS n_uses FROM (VALUES ('high'), ('medium'), ('low')) p(priority) LEFT JOIN u ON u.priority = p.priority GROUP BY 1")
def summary_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_priority(order_findings(spark, sf_dir), _no_tls(spark))


@query(f"{_USES} SELECT count(DISTINCT l_orderkey) AS files_with_findings, count(*) AS findings, count(*) FILTER (class = 'public-key') AS vulnerable_uses, count(DISTINCT CASE WHEN class = 'public-key' THEN l_orderkey END) AS vulnerable_files, count(*) FILTER (class = 'public-key') || ' quantum-vulnerable public-key use' || CASE WHEN count(*) FILTER (class = 'public-key') = 1 THEN '' ELSE 's' END || ' in ' || count(DISTINCT CASE WHEN class = 'public-key' THEN l_orderkey END) || ' files; 0 libraries; no TLS configuration found' AS verdict FROM u")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = order_findings(spark, sf_dir)
    none = spark.createDataFrame([], "priority string, key_exchange string")
    one = report.summary(Scan(findings, spark.createDataFrame([], "package string"), none, spark.createDataFrame([], "path string, reason string"), spark.createDataFrame([(0,)], "files_scanned long"), spark.createDataFrame([], "package string")))
    return one.select("files_with_findings", "findings", F.col("quantum_vulnerable.uses").alias("vulnerable_uses"), F.col("quantum_vulnerable.files").alias("vulnerable_files"), "verdict")


@query(f"{_USES} SELECT note AS code, count(*) AS n_places, CAST(min(line) FILTER (l_orderkey = 0) AS BIGINT) AS line_in_first FROM u WHERE note IS NOT NULL GROUP BY 1")
def note_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_findings(spark, sf_dir)
    first = found.where(F.col("file") == "src/o0.js").select(F.explode("notes").alias("code"), "line").groupBy("code").agg(F.min("line").cast("bigint").alias("line_in_first"))
    return report.note_index(found).join(first, "code", "left").select("code", "n_places", "line_in_first")


_TWICE = "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey % 8 AS k FROM lineitem"


@query(f"SELECT {pick_sql('k', [a for _, a, _, _ in _LINES])} AS algorithm, count(*) AS n_uses FROM ({_TWICE}) GROUP BY 1")
def dedupe_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses at the same place count once: rows of an order with the same line number and call are repeats."""
    calls, fact = node_calls(files(spark.range(8).withColumnRenamed("id", "k"), F.concat(F.lit("k"), F.col("k").cast("string"), F.lit(".js")), F.concat(F.lit("const c = require('crypto');\n"), pick("k", [a for a, _, _, _ in _LINES]))))
    kinds = detect.node_crypto(calls).withColumn("k", F.regexp_extract("path", r"\d+", 0).cast("bigint"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 8).alias("k"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit(".js")).alias("file_"), "l_linenumber")
    found = rows.join(F.broadcast(kinds), "k").withColumn("path", F.col("file_")).withColumn("line", F.col("l_linenumber")).drop("k", "file_", "l_linenumber")  # eight kinds
    return detect.findings(settle(found.select(*detect.FOUND)), lexical.words(fact)).groupBy("algorithm").agg(F.count("*").alias("n_uses"))


_REVIEW = f"""{_USES}, g AS (SELECT algorithm, priority, note, count(*) AS uses, count(DISTINCT l_orderkey) AS files FROM u WHERE priority IS NOT NULL OR note IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS rank FROM g)"""


@query(f"{_REVIEW} SELECT algorithm, priority, uses, files, CAST(least(uses, 20) AS BIGINT) AS n_places, uses - least(uses, 20) AS more FROM r")
def agent_summary_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.to_review(order_findings(spark, sf_dir)).select("algorithm", "priority", "uses", "files", F.size("at").cast("bigint").alias("n_places"), F.col("more").cast("bigint").alias("more"))


@query(f"{_USES} SELECT algorithm, count(*) AS occurrences, max(CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 0 END) AS priority_rank, {pick_sql('min(k)', ['digest', 'digest', 'encrypt', 'keygen', 'keygen', 'generate', 'keyderive', 'sign'])} AS functions, 'cipherlode:algorithm:' || {pick_sql('min(k)', ['md5-md5', 'sha-256-sha-256', 'aes-128-cbc-128', 'ecdh-p-256-p-256', 'rsa-2048-bit-2048', 'random-csprng', 'pbkdf2-sha-256-sha-256-iterations-1000', 'rsassa-pkcs1-v1-5-sha-256'])} AS ref FROM u GROUP BY 1")
def cbom_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset = cbom.assets(cbom.uses(order_findings(spark, sf_dir), _empty_tls(spark)))
    rank = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "medium", 2).otherwise(0)
    return asset.select("algorithm", "occurrences", rank.alias("priority_rank"), F.array_join("functions", ",").alias("functions"), F.regexp_replace("ref", " ", "").alias("ref"))


@query(f"{_USES} SELECT 'node:crypto' AS provider, count(DISTINCT algorithm) AS n_assets FROM u")
def cbom_provides(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = cbom.uses(order_findings(spark, sf_dir), _empty_tls(spark))
    return cbom.provides(used, cbom.assets(used)).groupBy("provider").agg(F.count("*").alias("n_assets"))


@query(f"{_USES} SELECT 'src/o' || l_orderkey || '.js' AS file, CAST(line AS BIGINT) AS line, 'node:crypto:' || {pick_sql('k', ['createHash', 'createHash', 'createCipheriv', 'createECDH', 'generateKeyPairSync', 'randomBytes', 'pbkdf2Sync', 'createSign'])} AS symbol FROM u")
def cbom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bill of materials of all orders and suppliers, written as lines; read back: the occurrences of algorithms in the orders."""
    judged = tls.judge(tls.file_configurations(_tls_files(spark, sf_dir))).withColumn("in_test", F.lit(False))
    named = _named_packages(spark, sf_dir)
    whole = Scan(order_findings(spark, sf_dir), dependencies.roll_up(*named), judged, spark.createDataFrame([], "path string, reason string"), spark.createDataFrame([(0,)], "files_scanned long"), dependencies.places(*named))
    one = F.from_json(F.regexp_replace("line", "^,", ""), "location string, line long, symbol string")
    read = cbom.lines(whole, "orders", "2026-01-01T00:00:00.000Z").select(one.alias("o")).where("o.location LIKE 'src/o%' AND o.symbol IS NOT NULL")
    return read.select(F.col("o.location").alias("file"), "o.line", "o.symbol")


def _empty_tls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file string, line int, server string, groups array<string>, priority string, replacement string, evidence string")


@query("SELECT algorithm, class, count(*) AS n_occurrences FROM (SELECT unnest(CASE s_suppkey % 5 WHEN 0 THEN ['X25519MLKEM768', 'X25519'] WHEN 1 THEN ['ECDH P-256'] WHEN 3 THEN ['X25519', 'ECDH P-256'] WHEN 4 THEN ['X25519MLKEM768', 'X25519'] ELSE [] END) AS algorithm FROM supplier) s, (VALUES ('X25519MLKEM768', 'post-quantum'), ('X25519', 'public-key'), ('ECDH P-256', 'public-key')) c(a, class) WHERE a = algorithm GROUP BY 1, 2")
def cbom_tls_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = tls.judge(tls.file_configurations(_tls_files(spark, sf_dir)))
    group = B.group_algorithm(F.col("g"))
    return judged.select(F.explode("groups").alias("g")).select(group.alias("a")).groupBy("a.algorithm", "a.class").agg(F.count("*").alias("n_occurrences"))


@query(None)
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report for people over the supplier configurations and lockfiles, as lines."""
    source = _tls_files(spark, sf_dir).union(_supplier_files(spark, sf_dir, "package.json", F.lit('{"dependencies": {"jose": "^5.0.0"}}')))
    return report.markdown_lines(settled(scan_table(source)), "suppliers", "2026-01-01T00:00:00.000Z").select("section", "line")
