"""Session defaults and the shared scratch location."""
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(app="barloom", master=None, **conf):
    """Session with AQE, skew-join handling and UTC; callers may override any key."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # the JIT leaves larger methods uncompiled; wide feature projections then run
        # faster outside one fused method
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    defaults.update(conf)
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark, purpose):
    """A fresh path under the shared checkpoint folder of the cluster.

    The folder named by ``spark.checkpoint.dir`` is used when it is set. Only
    where it is not (tests on one machine) is a temporary folder created, and
    the setting is left on the session so that later calls share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df, purpose):
    """df, written to a fresh shared folder and read back: computed once, and lineage ends there."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df, purpose, key, parts, order=()):
    """``stored``, dealt out by a key into ``parts`` buckets: whoever reads it groups or windows by the key without an exchange."""
    path = shared_dir(df.sparkSession, purpose)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    writer = df.repartition(parts, key).write.format("parquet").option("path", path).bucketBy(parts, key)
    writer.sortBy(key, *order).saveAsTable(name)
    return df.sparkSession.table(name)


def compiled(spark, source, name):
    """A new object of a Java class given as source text, by the compiler that Spark generates code with.

    The application gets the classes as a jar, once, so executors need no copy of the package and no compiler.
    """
    context = spark.sparkContext
    held = context.__dict__.setdefault("_barloom_classes", {})
    if (name, source) not in held:
        compiler = context._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source)
        path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), f"{name}-{uuid.uuid4().hex}.jar")
        codes = compiler.getBytecodes()
        with zipfile.ZipFile(path, "w") as jar:
            for part in codes:
                jar.writestr(part.replace(".", "/") + ".class", bytes(codes[part]))
        context._jsc.addJar(path)
        held[name, source] = compiler.getClassLoader().loadClass(name)
    none = context._gateway.new_array(context._jvm.java.lang.Class, 0), context._gateway.new_array(context._jvm.java.lang.Object, 0)
    return held[name, source].getConstructor(none[0]).newInstance(none[1])
