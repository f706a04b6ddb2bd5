"""What the driver's allocators hold without need.

Memory that learning or a job has freed stays with the process: Arrow's pool and malloc's arenas,
of Python and of the JVM, keep it for later, which the system counts as used. Over a pipeline of many
jobs that is about 80 MB of Python's and 150 MB of the JVM's. Nothing here changes a result.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


def give_back(spark: SparkSession) -> bool:
    """Hand free memory of the driver's Python and JVM back to the system; says if the JVM could (Java 17.0.9 or later, on Linux with glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)
    return _trim_jvm(spark)


def _trim_jvm(spark: SparkSession) -> bool:
    """The JVM's own command System.trim_native_heap; its bean's class is hidden, so that the interface's method is called."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    lang = jvm.java.lang

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for k, v in enumerate(values):
            out[k] = v
        return out

    try:
        beans = lang.management.ManagementFactory.getPlatformMBeanServer()
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        objects, strings = array(lang.Object), array(lang.String)
        kinds = array(lang.Class, commands.getClass(), lang.Class.forName("java.lang.String"), objects.getClass(), strings.getClass())
        invoke = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(beans, array(lang.Object, commands, "systemTrimNativeHeap", objects, strings))
    except Py4JError:  # no such command in this JVM
        return False
    return True
