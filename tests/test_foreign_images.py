"""Files of another program, the Java image library, read by our codecs, and ours read by it."""

import numpy as np
import pytest

from terrapix.functions import codecs, jpeg

H, W = 11, 19


@pytest.fixture(scope="module")
def picture():
    y, x = np.mgrid[0:H, 0:W]
    return np.stack([(x * 13) % 256, (y * 21 + x) % 256, (x * y * 3) % 256], axis=2).astype(np.uint8)


def _to_java(spark, picture):
    jvm = spark.sparkContext._jvm
    kind = jvm.java.awt.image.BufferedImage.TYPE_3BYTE_BGR
    image = jvm.java.awt.image.BufferedImage(picture.shape[1], picture.shape[0], kind)
    for y, line in enumerate(picture.tolist()):
        for x, (r, g, b) in enumerate(line):
            image.setRGB(x, y, (r << 16) | (g << 8) | b)
    return image


def _written(spark, image, name, compression=None, quality=None):
    jvm = spark.sparkContext._jvm
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(name).next()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    param = writer.getDefaultWriteParam()
    if compression or quality:
        param.setCompressionMode(jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT)
    if compression:
        param.setCompressionType(compression)
    if quality:
        param.setCompressionQuality(quality)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    writer.getOutput().flush()
    return bytes(out.toByteArray())


def _read(spark, data):
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    rgb = [[image.getRGB(x, y) & 0xFFFFFF for x in range(image.getWidth())] for y in range(image.getHeight())]
    v = np.array(rgb)
    return np.stack([v >> 16, v >> 8 & 255, v & 255], axis=2).astype(np.uint8)


def test_png_of_another_program(spark, picture):
    assert (codecs.png_decode(_written(spark, _to_java(spark, picture), "png")) == picture).all()
    assert (_read(spark, codecs.png_encode(picture)) == picture).all()


@pytest.mark.parametrize("compression", [None, "LZW", "PackBits", "ZLib", "Deflate"])
def test_tiff_of_another_program(spark, picture, compression):
    image, _ = codecs.tiff_decode(_written(spark, _to_java(spark, picture), "tiff", compression))
    assert (image == picture).all()


@pytest.mark.parametrize("codec", ["raw", "lzw", "pkb", "zip"])
def test_our_tiff_in_another_program(spark, picture, codec):
    assert (_read(spark, codecs.tiff_encode(picture, codec)) == picture).all()


def test_jpeg_of_another_program(spark):
    y, x = np.mgrid[0:24, 0:40]
    smooth = np.stack([128 + 100 * np.sin(x / 9) * np.cos(y / 7), 128 + 90 * np.sin(x / 11 + 1), 100 + 2 * y], axis=2).astype(np.uint8)
    data = _written(spark, _to_java(spark, smooth), "jpeg", None, 0.95)
    ours, theirs = jpeg.decode(data).astype(int), _read(spark, data).astype(int)
    assert np.abs(ours - theirs).mean() < 3 and np.abs(ours - smooth).mean() < 4
    assert np.abs(_read(spark, jpeg.encode(smooth, 95)).astype(int) - smooth).mean() < 4
