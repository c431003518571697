"""quarry: a Spark-native engine that indexes source trees and text collections and searches them."""

__version__ = "0.1.0"
