"""parcelwise: order-risk analytics expressed as Spark DataFrame jobs."""
